"""Panel analytics on Spark: daily bars -> features -> splits -> models -> backtest."""

from barloom.params import ResearchParams

__all__ = ["ResearchParams"]
