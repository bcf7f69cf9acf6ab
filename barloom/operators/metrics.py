"""Classification metrics over the long predictions table, one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import binomial_upper_tail, clip, guard, ratio
from barloom.operators.ordered import running_totals

# Probability clip and the metrics for which smaller is better.
EPS = 1e-15
LOWER_IS_BETTER = frozenset({"log_loss", "brier"})
GROUP = ("split", "model")


def clipped(prob: str = "prob_up") -> Column:
    return clip(F.col(prob), EPS, 1 - EPS)


def confusion_counts(predictions: DataFrame, threshold: float = 0.5, keys=GROUP) -> DataFrame:
    """Counts and additive scores per group: a single map-side combined aggregation."""
    p, y = clipped(), F.col("target")
    up = p >= threshold
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if((y == 1) & up).alias("tp"),
        F.count_if((y == 0) & up).alias("fp"),
        F.count_if((y == 0) & ~up).alias("tn"),
        F.count_if((y == 1) & ~up).alias("fn"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )


def roc_auc(predictions: DataFrame, keys=GROUP) -> DataFrame:
    """Exact area under the ROC curve with average ranks for ties; NULL with one class."""
    keys = list(keys)
    y = F.col("target")
    scored = predictions.select(*keys, clipped().alias("_p"), y.alias("target"))
    totals = running_totals(
        scored, keys, "_p", {"pos": (y == 1).cast("long"), "neg": (y == 0).cast("long")}
    )
    # A positive beats every negative below it and half of those tied with it.
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return totals.groupBy(*keys).agg(
        ratio(
            F.sum(wins),
            F.first("pos_total").cast("double") * F.first("neg_total").cast("double"),
        ).alias("roc_auc")
    )


def classification_table(predictions: DataFrame, threshold: float = 0.5, keys=GROUP) -> DataFrame:
    """Every metric per group. Rows with a missing label or probability are an error."""
    keys = list(keys)
    counts = confusion_counts(predictions, threshold, keys)
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    complete = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") == F.col("n")
    base = (tp + fn) / n
    majority = F.greatest(base, 1.0 - base)
    zero = F.lit(0.0)
    auc = roc_auc(predictions, keys)
    return counts.join(auc, keys, "left").select(
        *keys,
        guard(~complete, "predictions contain a missing label or probability", F.col("n"), "bigint").alias("n"),
        base.alias("base_rate"),
        ((tp + fp) / n).alias("pred_up_rate"),
        ((tp + tn) / n).alias("accuracy"),
        ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0).alias("balanced_accuracy"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2.0 * tp, 2.0 * tp + fp + fn), zero).alias("f1"),
        "roc_auc", "log_loss", "brier", "tn", "fp", "fn", "tp",
        F.when(
            (majority > 0) & (majority < 1),
            binomial_upper_tail(F.col("tp") + F.col("tn"), F.col("n"), majority),
        ).alias("acc_pvalue_vs_majority"),
    )


def better(metric: str, a: Column, b: Column) -> Column:
    """Whether score `a` beats `b`; a missing score never beats a real one."""
    wins = a < b if metric in LOWER_IS_BETTER else a > b
    return F.when(a.isNull(), False).when(b.isNull(), True).otherwise(wins)


def select_model(
    scores: DataFrame, metric: str = "log_loss", baseline: str = "majority",
    order: list[str] | None = None,
) -> DataFrame:
    """Mark the best non-baseline model (first declared wins ties) and baseline comparison.

    One row per model, so the ordering window holds a handful of rows.
    """
    rank = (
        F.array_position(F.array(*(F.lit(m) for m in order)), F.col("model"))
        if order else F.col("model")
    )
    score = F.col(metric)
    direction = (
        score.asc_nulls_last() if metric in LOWER_IS_BETTER else score.desc_nulls_last()
    )
    contender = F.col("model") != baseline
    w = Window.partitionBy(contender).orderBy(direction, rank)
    everyone = Window.partitionBy(F.lit(1))
    picked = scores.withColumn("selected", contender & (F.row_number().over(w) == 1))
    best = F.max(F.when(F.col("selected"), score)).over(everyone)
    base = F.max(F.when(~contender, score)).over(everyone)
    has_baseline = F.count_if(~contender).over(everyone) > 0
    return picked.withColumn("selected_beats_majority", has_baseline & better(metric, best, base))
