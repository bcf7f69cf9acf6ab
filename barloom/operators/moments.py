"""Sums over rows that tasks add up in small matrices: one record per key and task leaves a task.

`run` sees Arrow batches and must hold all it needs itself, since executors have no copy of this package. Sums of
tasks are added as decimals, so the order in which they arrive does not change a single bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks' sums are rounded to so many decimals before they are added.
PLACES = 18


def summed(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(key, at, total) of the (key int, sums array<double>) records that `run` makes of each task's batches."""
    parts = rows.mapInArrow(run, "key int, sums array<double>")
    exact = F.sum(F.col("part").cast(f"decimal(38,{PLACES})")).cast("double")
    return parts.select("key", F.posexplode("sums").alias("at", "part")).groupBy("key", "at").agg(exact.alias("total"))
