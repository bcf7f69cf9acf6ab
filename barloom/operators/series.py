"""The numbers behind each chart: curves, confusion shares, ROC, calibration, histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import Trailing, running
from barloom.operators.ordered import running_totals

KEYS = ("split", "strategy")


def equity_curves(series: DataFrame) -> DataFrame:
    """Cumulative return, drawdown from the curve's own peak, per strategy and date."""
    w = running(Window.partitionBy(*KEYS).orderBy("date"))
    level = F.product(1.0 + F.coalesce("net_ret", F.lit(0.0))).over(w)
    return (
        series.select(*KEYS, "date", level.alias("_level"))
        .withColumn("_peak", F.max("_level").over(w))
        .select(
            *KEYS, "date",
            (F.col("_level") - 1.0).alias("cumulative_return"),
            (F.col("_level") / F.col("_peak") - 1.0).alias("drawdown"),
        )
    )


def path_max_drawdown(path: DataFrame, value: str = "adj_close", keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Worst fall from a running peak, per key, over a path ordered by date (one row per calendar date).

    A missing value anywhere makes the result missing: the fall through it is unknown.
    """
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = path.select(*keys, value, F.max(value).over(w).alias("_peak"))
    whole = F.count(value) == F.count("*")
    return rows.groupBy(*keys).agg(F.when(whole, F.min(F.col(value) / F.col("_peak") - 1)).alias("max_drawdown"))


def rolling_volatility(series: DataFrame, window: int = 63, periods: int = 252) -> DataFrame:
    t = Trailing(*KEYS)
    out = {"rolling_vol": t.deviation("net_ret", window) * math.sqrt(periods)}
    return t.compute(series.select(*KEYS, "date", "net_ret"), [*KEYS, "date"], out)


def confusion_shares(counts: DataFrame) -> DataFrame:
    """Each confusion cell with its share of the actual class (empty classes count as 1)."""
    cell = lambda actual, predicted, n: F.struct(
        F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"), F.col(n).alias("n"),
        (F.col("tn") + F.col("fp") if actual == "down" else F.col("fn") + F.col("tp")).alias("row"),
    )
    cells = F.array(
        cell("down", "down", "tn"), cell("down", "up", "fp"),
        cell("up", "down", "fn"), cell("up", "up", "tp"),
    )
    return counts.select("split", "model", F.inline(cells)).select(
        "split", "model", "actual", "predicted", "n",
        (F.col("n") / F.greatest(F.col("row"), F.lit(1))).alias("row_share"),
    )


def _by_probability(predictions: DataFrame, keys: list[str], *names: str) -> DataFrame:
    y = F.col("target")
    sums = {"n": F.lit(1).cast("long"), "pos": y.cast("long"), "neg": (1 - y).cast("long")}
    return running_totals(
        predictions.select(*keys, "prob_up", "target"), keys, "prob_up", {n: sums[n] for n in names}
    )


def roc_points(predictions: DataFrame, keys: tuple[str, ...] = ("split", "model")) -> DataFrame:
    """ROC corner points per group with both classes; interior collinear points are dropped.

    Thresholds descend, so "before" a threshold means larger probabilities. A point is
    interior when the next smaller probability adds exactly the same counts.
    """
    keys = list(keys)
    t = _by_probability(predictions, keys, "pos", "neg").where("pos_total > 0 and neg_total > 0")
    interior = (
        ~F.col("is_largest")
        & F.coalesce(F.col("pos") == F.col("pos_below"), F.lit(False))
        & F.coalesce(F.col("neg") == F.col("neg_below"), F.lit(False))
    )
    corner = F.struct(
        F.col("prob_up").alias("threshold"),
        ((F.col("neg_total") - F.col("neg_before")) / F.col("neg_total")).alias("fpr"),
        ((F.col("pos_total") - F.col("pos_before")) / F.col("pos_total")).alias("tpr"),
    )
    origin = F.when(F.col("is_largest"), F.struct(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    ))
    points = F.array_compact(F.array(F.when(~interior, corner), origin))
    return t.select(*keys, F.inline(points))


def _quantile_edges(totals: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Inner quantile edges with linear interpolation, read off the running counts.

    The value at rank r is the largest one with fewer than or equal to r values below it.
    """
    n = F.col("n_total")
    sums = []
    for j in range(1, bins):
        position = (n - 1) * (j / bins)
        low = F.floor(position)
        at = lambda rank: F.max(F.when(F.col("n_before") <= rank, F.col("prob_up")))
        lower, upper = at(low), at(F.ceil(position))
        weight = F.max(position - low)
        sums.append((lower + (upper - lower) * weight).alias(f"_e{j}"))
    return totals.groupBy(*keys).agg(*sums, F.count("*").alias("_distinct")).select(
        *keys, "_distinct", F.array(*(f"_e{j}" for j in range(1, bins))).alias("_edges")
    )


def calibration_curve(
    predictions: DataFrame, bins: int = 10, baseline: str | None = "majority"
) -> DataFrame:
    """Mean prediction and observed rate in equal-count bins; constant models are skipped."""
    keys = ["split", "model"]
    if baseline:
        predictions = predictions.where(F.col("model") != baseline)
    totals = _by_probability(predictions, keys, "n")
    edges = _quantile_edges(totals, keys, bins).where("_distinct > 1")
    counted = predictions.groupBy(*keys, "prob_up").agg(
        F.count("*").alias("n"), F.sum("target").alias("pos")
    )
    p = F.col("prob_up")
    place = sum(((F.col("_edges")[j] < p).cast("int") for j in range(bins - 1)), F.lit(0))
    return (
        counted.join(F.broadcast(edges), keys)
        .withColumn("bin", place)
        .groupBy(*keys, "bin")
        .agg(
            (F.sum(p * F.col("n")) / F.sum("n")).alias("mean_predicted"),
            (F.sum("pos") / F.sum("n")).alias("observed_rate"),
            F.sum("n").alias("n"),
        )
    )


def probability_histogram(
    predictions: DataFrame, bins: int = 40, baseline: str | None = "majority"
) -> DataFrame:
    """Equal-width counts from each model's smallest to largest probability."""
    keys = ["split", "model"]
    if baseline:
        predictions = predictions.where(F.col("model") != baseline)
    p = F.col("prob_up")
    counted = predictions.groupBy(*keys, "prob_up").agg(F.count("*").alias("n"))
    spans = counted.groupBy(*keys).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi")).where("_hi > _lo")
    bucket = F.least(
        F.floor((p - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * float(bins)), F.lit(bins - 1)
    )
    # One row per model.
    return counted.join(F.broadcast(spans), keys).groupBy(*keys, bucket.alias("bin")).agg(
        F.sum("n").alias("n")
    )
