"""Predictions that need no estimator: the prior baseline and fixed score rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREDICTION_COLUMNS = ("date", "ticker", "split", "model", "prob_up", "target", "fwd_ret")


def prediction_rows(rows: DataFrame, model: str, prob: Column, split: str | None = None) -> DataFrame:
    """Tidy prediction rows; `split` overrides the column of that name."""
    return rows.select(
        "date", "ticker",
        (F.lit(split) if split else F.col("split")).alias("split"),
        F.lit(model).alias("model"), prob.cast("double").alias("prob_up"), "target", "fwd_ret",
    )


def class_weights(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Balanced weight n / (2 n_class) per class of the fitted rows: two rows per key."""
    counts = rows.groupBy(*keys, "target").agg(F.count("*").alias("n_class"))
    total = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return counts.withColumn(
        "weight", F.sum("n_class").over(total) / (2.0 * F.col("n_class"))
    )


def fold_class_weights(panel: DataFrame, axis: DataFrame, folds: DataFrame) -> DataFrame:
    """Class weights of every fold's training rows.

    Classes are counted once per date; running totals along the date axis, read at the last training date, give
    the folds. No panel row is copied. Training starts at the first date, as in all folds made here.
    """
    per = panel.groupBy("date", "target").agg(F.count("*").alias("n"))
    days = axis.select("date", "ordinal").join(per.groupBy("date").agg(
        F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("up"), F.sum("n").alias("n")), "date")
    so_far = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    totals = days.select(F.col("ordinal").cast("long"), F.sum("up").over(so_far).alias("up"), F.sum("n").over(so_far).alias("n"))
    ends = folds.select("fold", (F.col("train_to") - 1).cast("long").alias("ordinal")).join(totals, "ordinal")
    classes = F.array(F.struct(F.lit(0).alias("target"), (F.col("n") - F.col("up")).alias("n_class")),
                      F.struct(F.lit(1).alias("target"), F.col("up").alias("n_class")))
    return ends.select("fold", "n", F.inline(classes)).where("n_class > 0").select(
        "fold", "target", "n_class", (F.col("n") / (2.0 * F.col("n_class"))).alias("weight"))


def priors(tagged: DataFrame) -> DataFrame:
    """Prior probability used in each scored split: train for validation, both for test."""
    per = tagged.where(F.col("split").isin("train", "validation")).groupBy("split").agg(
        F.sum("target").alias("up"), F.count("*").alias("n")
    )
    train = F.col("split") == "train"
    return per.agg(
        F.sum(F.when(train, F.col("up"))).alias("ut"), F.sum(F.when(train, F.col("n"))).alias("nt"),
        F.sum("up").alias("ud"), F.sum("n").alias("nd"),
    ).select(F.inline(F.array(
        F.struct(F.lit("validation").alias("split"), (F.col("ut") / F.col("nt")).alias("prior")),
        F.struct(F.lit("test").alias("split"), (F.col("ud") / F.col("nd")).alias("prior")),
    )))


def majority_predictions(tagged: DataFrame, model: str = "majority") -> DataFrame:
    """Every validation and test row gets its split's prior (a two-row equi-join)."""
    scored = tagged.where(F.col("split").isin("validation", "test"))
    joined = scored.join(F.broadcast(priors(tagged)), "split")
    return prediction_rows(joined, model, F.col("prior"))


def score_predictions(tagged: DataFrame) -> DataFrame:
    """Momentum, its mirror image and a constant, as three models of the same rows.

    Momentum squashes the five-day return by x / (1 + |x|), which any IEEE engine computes alike.
    """
    x = 20.0 * F.col("ret_5d")
    momentum = 0.5 + x / (2.0 * (1.0 + F.abs(x)))
    models = F.array(
        F.struct(F.lit("momentum").alias("model"), momentum.alias("prob_up")),
        F.struct(F.lit("reversal").alias("model"), (1.0 - momentum).alias("prob_up")),
        F.struct(F.lit("constant").alias("model"), F.lit(0.5).alias("prob_up")),
    )
    scored = tagged.where(F.col("split").isin("validation", "test"))
    return scored.select("date", "ticker", "split", "target", "fwd_ret", F.inline(models)).select(
        *PREDICTION_COLUMNS
    )


def walk_forward_priors(panel: DataFrame, axis: DataFrame, folds: DataFrame) -> DataFrame:
    """Prior of each fold's training dates from one running total along the date axis."""
    so_far = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    per_date = panel.groupBy("date").agg(F.sum("target").alias("up"), F.count("*").alias("n"))
    running = axis.select("date", "ordinal").join(per_date, "date").select(
        "ordinal", (F.sum("up").over(so_far) / F.sum("n").over(so_far)).alias("prob_up")
    )
    return folds.withColumn("ordinal", F.col("train_to") - 1).join(
        F.broadcast(running), "ordinal"
    ).select("fold", "test_from", "test_to", "prob_up")


def walk_forward_majority(
    panel: DataFrame, axis: DataFrame, folds: DataFrame, min_train: int, test_days: int,
    model: str = "majority",
) -> DataFrame:
    """Out-of-sample prior per fold; a row's fold follows from its date's ordinal."""
    fold = F.floor((F.col("ordinal") - min_train) / test_days)
    dates = axis.where(F.col("ordinal") >= min_train).select("date", fold.cast("int").alias("fold"))
    known = dates.join(walk_forward_priors(panel, axis, folds).select("fold", "prob_up"), "fold")
    rows = panel.join(F.broadcast(known), "date")
    return rows.select(
        "date", "ticker", F.lit("walk_forward").alias("split"), F.lit(model).alias("model"),
        "prob_up", "target", "fwd_ret", "fold",
    )
