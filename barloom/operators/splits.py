"""Chronological segments and folds, decided on the distinct-date axis.

The axis has one row per calendar date, a bound that does not grow with the number of
tickers or rows. It is the only table windowed without a partition key and the only one
broadcast back to the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import guard
from barloom.params import ResearchParams, SplitParams

SEGMENTS = ("train", "validation", "test")
FEWEST_DATES = 10


def date_axis(panel: DataFrame) -> DataFrame:
    """(date, ordinal, n_dates, n_rows): every distinct date in order, from 0."""
    everything = Window.orderBy("date")
    return (
        panel.groupBy("date").agg(F.count("*").alias("n_rows"))
        .select(
            "date",
            (F.row_number().over(everything) - 1).alias("ordinal"),
            F.count("*").over(everything.rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_dates"),
            "n_rows",
        )
    )


def _segment_sizes(p: SplitParams) -> tuple[Column, Column]:
    """Dates before validation, and dates before test."""
    if p.by_date():
        whole = Window.orderBy("date").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
        upto = lambda end: F.count_if(F.col("date") <= F.lit(str(end)).cast("date")).over(whole)
        return upto(p.train_end), upto(p.val_end)
    n = F.col("n_dates")
    n_train = F.floor(n * F.lit(float(p.train_frac)))
    return n_train, n_train + F.floor(n * F.lit(float(p.val_frac)))


def date_segments(axis: DataFrame, params: ResearchParams | None = None) -> DataFrame:
    """`axis` with its segment; purged dates get NULL.

    Too few dates, or a segment with nothing left after purging, fail when evaluated.
    """
    params = params or ResearchParams()
    purge = params.purge_days()
    val_at, test_at = _segment_sizes(params.split)
    sized = axis.select("*", val_at.alias("_val"), test_at.alias("_test"))
    i = F.col("ordinal")
    segment = (
        F.when(i < F.col("_val") - purge, "train")
        .when((i >= F.col("_val")) & (i < F.col("_test") - purge), "validation")
        .when(i >= F.col("_test"), "test")
    )
    too_short = (
        (F.col("_val") <= purge) | (F.col("_test") - F.col("_val") <= purge)
        | (F.col("n_dates") <= F.col("_test"))
    )
    segment = guard(too_short, "a split segment is empty: adjust split dates or fractions", segment, "string")
    segment = guard(
        F.col("n_dates") < FEWEST_DATES, "too few dates to split chronologically", segment, "string"
    )
    return sized.select(*axis.columns, segment.alias("split"))


def tag_rows(panel: DataFrame, dates: DataFrame, *columns: str) -> DataFrame:
    """Copy per-date columns onto every row of that date (one row per date: broadcast)."""
    return panel.join(F.broadcast(dates.select("date", *columns)), "date")


def chronological_split(panel: DataFrame, params: ResearchParams | None = None) -> DataFrame:
    """The panel with `ordinal` and `split`; rows on purged dates carry a NULL split."""
    return tag_rows(panel, date_segments(date_axis(panel), params), "ordinal", "split")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Range, dates and rows of each segment, from the tagged date axis alone."""
    return (
        segments.where(F.col("split").isNotNull())
        .groupBy(F.col("split").alias("name"))
        .agg(
            F.min("date").alias("start"), F.max("date").alias("end"),
            F.count("*").alias("n_dates"), F.sum("n_rows").alias("n_rows"),
        )
    )


def chronology_violations(summary: DataFrame) -> DataFrame:
    """Consecutive segments that touch or overlap; empty when all is in order."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SEGMENTS)), F.col("name"))
    return (
        summary.withColumn("previous_end", F.lag("end").over(Window.orderBy(rank)))
        .where(F.col("previous_end") >= F.col("start"))
        .select("name", "previous_end", "start")
    )


def assert_chronological(summary: DataFrame) -> None:
    bad = chronology_violations(summary).first()
    if bad:
        raise AssertionError(
            f"segment {bad['name']} starts {bad['start']}, not after {bad['previous_end']}"
        )


def cv_folds(axis: DataFrame, n_splits: int, gap: int = 1) -> DataFrame:
    """Expanding folds over dates as ordinal bounds [start, end) per fold and role."""
    n = F.max("ordinal") + 1
    size = F.floor(F.col("n") / (n_splits + 1))
    test_start = F.col("n") - (n_splits - F.col("fold")) * F.col("size")
    return (
        axis.agg(n.alias("n"))
        .select("n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
        .select(
            "fold",
            F.lit(0).cast("long").alias("train_from"),
            F.greatest(test_start - gap, F.lit(0)).cast("long").alias("train_to"),
            test_start.cast("long").alias("test_from"),
            (test_start + F.col("size")).cast("long").alias("test_to"),
        )
    )


def walk_forward_folds(axis: DataFrame, min_train: int, test_days: int, purge: int = 1) -> DataFrame:
    """Expanding walk-forward folds as ordinal bounds [start, end)."""
    n = F.col("n")
    enough = guard(
        n <= min_train, "walk-forward needs more dates than min_train_days", n, "bigint"
    )
    start = F.col("test_from")
    return (
        axis.agg((F.max("ordinal") + 1).cast("long").alias("n"))
        .select(enough.alias("n"))
        .select("n", F.posexplode(
            F.sequence(F.lit(min_train).cast("long"), n - 1, F.lit(test_days).cast("long"))
        ).alias("fold", "test_from"))
        .select(
            "fold",
            F.lit(0).cast("long").alias("train_from"),
            F.greatest(start - purge, F.lit(1)).cast("long").alias("train_to"),
            start.alias("test_from"),
            F.least(start + test_days, n).cast("long").alias("test_to"),
        )
    )


def fold_table(folds: DataFrame, axis: DataFrame) -> DataFrame:
    """Folds with their dates and row counts.

    Row counts come from a running total along the axis, looked up at the four edges of
    each fold: fold membership of single rows is never materialised.
    """
    so_far = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    totals = axis.select(
        "ordinal", "date", "n_rows", F.sum("n_rows").over(so_far).alias("through")
    )
    edge = lambda name, at: F.struct(F.lit(name).alias("edge"), at.cast("long").alias("ordinal"))
    edges = folds.select("fold", F.inline(F.array(
        edge("train_start", F.col("train_from")), edge("train_end", F.col("train_to") - 1),
        edge("test_start", F.col("test_from")), edge("test_end", F.col("test_to") - 1),
    )))
    found = edges.join(
        F.broadcast(totals.withColumn("ordinal", F.col("ordinal").cast("long"))), "ordinal"
    )
    at = lambda name, value: F.max(F.when(F.col("edge") == name, value))
    through, before = F.col("through"), F.col("through") - F.col("n_rows")
    return found.groupBy("fold").agg(
        *(at(name, F.col("date")).alias(name) for name in ("train_start", "train_end", "test_start", "test_end")),
        (at("train_end", through) - at("train_start", before)).alias("train_rows"),
        (at("test_end", through) - at("test_start", before)).alias("test_rows"),
    )


def fold_dates(folds: DataFrame, axis: DataFrame) -> DataFrame:
    """(fold, role, date): which dates each fold trains and tests on."""
    spans = folds.select("fold", F.explode(F.array(
        F.struct(F.lit("train").alias("role"), F.col("train_from").alias("a"), F.col("train_to").alias("b")),
        F.struct(F.lit("test").alias("role"), F.col("test_from").alias("a"), F.col("test_to").alias("b")),
    )).alias("span"))
    days = spans.where("span.b > span.a").select(
        "fold", "span.role", F.explode(F.sequence(F.col("span.a"), F.col("span.b") - 1)).alias("ordinal")
    )
    return days.join(axis.select("ordinal", "date", "n_rows"), "ordinal").drop("ordinal")


def assign_folds(panel: DataFrame, folds: DataFrame, axis: DataFrame) -> DataFrame:
    """Panel rows tagged with fold and role; a row appears once per fold it takes part in."""
    return panel.join(F.broadcast(fold_dates(folds, axis).drop("n_rows")), "date")


def development_rows(tagged: DataFrame, scope: str = "full") -> DataFrame:
    """Rows open to fold work: everything, or only train and validation."""
    return tagged if scope == "full" else tagged.where(F.col("split").isin("train", "validation"))
