"""Inputs of the registered queries, all derived by Spark from the given tables.

Bars, panel and score predictions are durable cut points: each is written once per
application and data folder to the shared folder, then read back by later queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import rnd
from barloom.operators import backtest, baseline, panel, splits
from barloom.params import DataParams, ResearchParams, WalkForwardParams
from barloom.sources import tpch
from barloom.sources.session import shared_folder, tune
from barloom.sources.tables import _exists, file_facts

MARKET = "STANDARD"
PARAMS = ResearchParams(
    data=DataParams(market_ticker=MARKET, min_rows=300),
    walk_forward=WalkForwardParams(min_train_days=400, test_days=126),
)
#: The score rules of `baseline.score_predictions`.
SCORE_MODELS = ("momentum", "reversal", "constant")
_written: dict[tuple[str, str, str], str] = {}


def input_facts(spark: SparkSession, sf_dir: str) -> str:
    """The given files as they are now: a changed file means new inputs."""
    return f"{sf_dir} {hash(file_facts(spark, sf_dir))}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, input_facts(spark, sf_dir), name)
    path = _written.get(key)
    if path is None or not _exists(spark, f"{path}/_SUCCESS"):
        path = shared_folder(spark)
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(path)


def neat(df: DataFrame, places: int = 8) -> DataFrame:
    """Doubles at a fixed number of decimals, so that engines can be compared exactly."""
    return df.select(*(
        rnd(f"`{f.name}`", places).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(tune(spark), sf_dir, "bars", lambda: tpch.daily_bars(spark, sf_dir))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.full_panel(bars(spark, sf_dir), PARAMS)


def the_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "panel", lambda: panel.complete_rows(full_panel(spark, sf_dir)))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.date_axis(the_panel(spark, sf_dir))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological_split(the_panel(spark, sf_dir), PARAMS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the score models and the prior baseline."""
    def build():
        rows = tagged(spark, sf_dir)
        return baseline.score_predictions(rows).unionByName(baseline.majority_predictions(rows))

    return stored(spark, sf_dir, "scores", build)


def trend_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the trend feature at eight decimals, as a stored panel would have it."""
    return the_panel(spark, sf_dir).withColumn("dist_ma_50", rnd("dist_ma_50"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.benchmark_frame(
        scores(spark, sf_dir), trend_panel(spark, sf_dir), "majority", PARAMS.backtest
    )


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = backtest.model_signals(scores(spark, sf_dir), PARAMS.backtest)
    return models.unionByName(backtest.benchmark_signals(frame(spark, sf_dir), PARAMS.backtest))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.positions(strategies(spark, sf_dir), PARAMS.backtest.cost_bps)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "series", lambda: backtest.daily_series(
        strategies(spark, sf_dir), frame(spark, sf_dir), PARAMS.backtest))


def backtest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "backtest", lambda: backtest.backtest_table(
        scores(spark, sf_dir), trend_panel(spark, sf_dir), "majority", PARAMS.backtest))
