"""First-look queries over the finished panel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.moments import summed
from barloom.operators.ordered import default_blocks
from barloom.operators.panel import feature_columns

#: Blocks a ticker's values of one feature are cut into at the most: with 24 features, tasks for one ticker.
MOST_VALUE_BLOCKS = 64


def up_rate_by_year(panel: DataFrame, places: int = 3) -> DataFrame:
    """Share of up days per year and ticker, in long form: any number of tickers."""
    return (
        panel.groupBy(F.year("date").alias("year"), "ticker")
        .agg((F.floor(F.avg("target") * 10.0**places + 0.5) / 10.0**places).alias("up_rate"))
    )


def _value_blocks(panel: DataFrame, names: list[str], blocks: int) -> list[list[float]]:
    """Approximate quantiles of each column over the whole panel: columns x blocks numbers."""
    shares = [k / blocks for k in range(1, blocks)]
    row = panel.agg(*(F.percentile_approx(n, shares, 10_000).alias(f"_{k}") for k, n in enumerate(names))).first()
    return [sorted(set(row[k] or [])) for k in range(len(names))]


def _block_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts are below the value, by halving."""
    if not cuts:
        return F.lit(0)
    half = len(cuts) // 2
    return F.when(value > cuts[half], _block_of(value, cuts[half + 1:]) + (half + 1)).otherwise(_block_of(value, cuts[:half]))


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, _block, distinct value): n rows, sum and square sum of `other`, average rank within the block."""
    inside = Window.partitionBy(*keys, "_block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    other = F.col("other")
    merged = rows.groupBy(*keys, "_block", "value").agg(F.count("*").alias("n"), F.sum(other).alias("other"), F.sum(other * other).alias("square"))
    return merged.withColumn("_rank", F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2.0)


def rank_correlation(panel: DataFrame, names: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """Spearman correlation of each feature with the forward return, per ticker; equal values share their average rank.

    Equal values are merged first. The distinct ones of a ticker and feature are cut into value blocks at quantiles over the whole
    panel, so no block of any ticker has more than its share of all rows, and ranks run inside blocks. What lies in the blocks below
    (one small row per ticker, feature and block) is added to sums of ranks, which are linear in it; rows do not move for it.
    Rows with a missing value are left out.
    """
    names = names or feature_columns(panel)
    blocks = blocks or min(default_blocks(panel), MOST_VALUE_BLOCKS)
    cuts = _value_blocks(panel, ["fwd_ret", *names], blocks)
    below = lambda keys: Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda keys: F.coalesce(F.sum("_n").over(below(keys)), F.lit(0)).alias("_before")

    returns = _merged(panel.where("fwd_ret is not null").select(
        "ticker", _block_of(F.col("fwd_ret"), cuts[0]).alias("_block"), F.col("fwd_ret").alias("value"), F.lit(0.0).alias("other")), ["ticker"])
    offset = returns.groupBy("ticker", "_block").agg(F.sum("n").alias("_n")).select("ticker", "_block", before(["ticker"]))
    ranks = returns.join(offset, ["ticker", "_block"]).select("ticker", F.col("value").alias("fwd_ret"), (F.col("_rank") + F.col("_before")).alias("other"))

    cells = F.array(*(F.struct(F.lit(k).alias("_f"), F.col(n).cast("double").alias("value"), _block_of(F.col(n), cuts[k + 1]).alias("_block")) for k, n in enumerate(names)))
    long = panel.select("ticker", "fwd_ret", *names).join(ranks, ["ticker", "fwd_ret"]).select("ticker", "other", F.inline(cells)).where("value is not null")
    n, rank, other = F.col("n"), F.col("_rank"), F.col("other")
    sums = _merged(long, ["ticker", "_f"]).groupBy("ticker", "_f", "_block").agg(
        F.sum("n").alias("_n"), F.sum("other").alias("_y"), F.sum("square").alias("_yy"), F.sum(other * rank).alias("_xy"),
        F.sum(n * rank).alias("_x"), F.sum(n * rank * rank).alias("_xx"))
    c = F.col("_before")
    whole = sums.select("*", before(["ticker", "_f"])).groupBy("ticker", "_f").agg(
        F.sum("_n").cast("double").alias("n"), F.sum("_y").alias("y"), F.sum("_yy").alias("yy"), F.sum(F.col("_xy") + c * F.col("_y")).alias("xy"),
        F.sum(F.col("_x") + c * F.col("_n")).alias("x"), F.sum(F.col("_xx") + 2 * c * F.col("_x") + c * c * F.col("_n")).alias("xx"))
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))
    label = F.element_at(F.array(*(F.lit(x) for x in names)), F.col("_f") + 1)
    return whole.select("ticker", label.alias("feature"), F.when(spread > 0, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread)).alias("ic"))


def autocorrelation(panel: DataFrame, column: str = "ret_1d", lags: int = 5) -> DataFrame:
    """Correlation of a column with its own past, per ticker, one column per lag."""
    w = Window.partitionBy("ticker").orderBy("date")
    past = panel.select(
        "ticker", F.col(column).alias("_x"),
        *(F.lag(column, k).over(w).alias(f"_b{k}") for k in range(1, lags + 1)),
    )
    return past.groupBy("ticker").agg(
        *(F.corr("_x", f"_b{k}").alias(f"lag{k}") for k in range(1, lags + 1))
    )


def correlation_matrix(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pairwise feature correlations in long form, over rows where both features are known.

    Tasks multiply blocks of rows: counts, sums, squares and products of all pairs are one small matrix a task each.
    """
    names = names or feature_columns(panel)
    d = len(names)

    def run(batches):
        total = np.zeros((4, d, d))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            known = (~np.isnan(x)).astype(float)
            x = np.where(known > 0, x, 0.0)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        sums = pa.ListArray.from_arrays(pa.array(np.array([0, total.size], np.int32)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(1, np.int32)), sums], names=["key", "sums"])

    sums = summed(panel.select(*(F.col(n).cast("double").alias(n) for n in names)), run)
    cell = F.pmod("at", F.lit(d * d))
    part = lambda k: F.max(F.when(F.floor(F.col("at") / (d * d)) == k, F.col("total")))
    cells = sums.groupBy(cell.alias("_c")).agg(*(part(k).alias(f"_{n}") for k, n in enumerate(("n", "sx", "qx", "xy"))))
    here = cells.select(F.floor(F.col("_c") / d).cast("int").alias("_i"), (F.col("_c") % d).cast("int").alias("_j"), "_n", "_sx", "_qx", "_xy")
    there = here.select(F.col("_j").alias("_i"), F.col("_i").alias("_j"), F.col("_sx").alias("_sy"), F.col("_qx").alias("_qy"))
    n = F.col("_n")
    covariance = F.col("_xy") - F.col("_sx") * F.col("_sy") / n
    spread = (F.col("_qx") - F.col("_sx") * F.col("_sx") / n) * (F.col("_qy") - F.col("_sy") * F.col("_sy") / n)
    label = lambda c: F.element_at(F.array(*(F.lit(x) for x in names)), F.col(c) + 1)
    return here.join(F.broadcast(there), ["_i", "_j"]).select(  # features squared rows
        label("_i").alias("feature"), label("_j").alias("other"),
        F.when((n > 0) & (spread > 0), F.when(F.col("_i") == F.col("_j"), 1.0).otherwise(covariance / F.sqrt(spread))).alias("corr"))
