"""Turn raw vendor rows into clean daily bars, counting everything that was changed.

All per-day work happens in one hash aggregation on (ticker, date), so a day with any
number of copies collapses map-side, without a sort as long as the input order `_seq` is a
number (a struct would do, but sorts). After it a ticker holds at most one row per calendar
day, which bounds every later per-ticker window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import finite, is_true
from barloom.functions.windows import ticker_window
from barloom.params import DataParams

PRICES = ("open", "high", "low", "close", "adj_close")
BAR_COLUMNS = (*PRICES, "volume")
# Counter names of the cleaning report.
COUNTERS = (
    "duplicate_dates_dropped", "missing_adj_close_dropped", "nonpositive_price_dropped",
    "inconsistent_high_low_nulled", "negative_volume_nulled", "calendar_gaps_over_5_days",
)
MAX_QUIET_DAYS = 5


class DataError(RuntimeError):
    """The input cannot be used at all."""


def tidy_name(name: object) -> str:
    """Canonical column name; the first level of a two-level header."""
    if isinstance(name, (tuple, list)):
        name = name[0]
    return str(name).strip().lower().replace(" ", "_")


def normalise_columns(raw: DataFrame) -> DataFrame:
    return raw.toDF(*(tidy_name(c) for c in raw.columns))


def with_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Add `_seq` from columns that say which of two copies is later (a whole number each, or dates).

    With no columns the rows must be one per ticker and day, and any order does.
    """
    if not columns:
        return rows.withColumn("_seq", F.lit(0).cast("long"))
    return rows.withColumn("_seq", F.col(columns[0]) if len(columns) == 1 else F.struct(*columns))


def parse_date(column: Column, data_type: T.DataType) -> Column:
    """Exchange date: unreadable becomes NULL, a zone suffix is dropped, time is cut off."""
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, T.StringType):
        text = F.trim(column)
        wall_clock = F.regexp_replace(text, r"(?<=:\d{2})(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})$", "")
        # Plain dates, the common case, skip the pattern and the timestamp parser.
        return F.when(F.length(text) <= 10, text.try_cast("date")).otherwise(
            F.try_to_timestamp(wall_clock).cast("date")
        )
    return column.cast("date")


def parse_number(column: Column, data_type: T.DataType) -> Column:
    """Finite number or NULL; Java's numeric type suffixes (`1d`, `1f`) are not numbers."""
    if isinstance(data_type, T.StringType):
        column = F.when(~column.rlike(r"[dDfF]\s*$"), column).try_cast("double")
    return finite(column)


def schema_notes(columns: list[str]) -> list[str]:
    """What has to be made up for columns the source does not have."""
    notes = []
    if "adj_close" not in columns:
        if "close" not in columns:
            raise DataError(f"a price column (adj_close or close) is required, found {columns}")
        notes.append("no adj_close in the source: close stands in, so dividends are not adjusted for")
    notes += [
        f"no {c} in the source: left empty"
        for c in BAR_COLUMNS if c != "adj_close" and c not in columns
    ]
    return notes


def standardise(raw: DataFrame) -> DataFrame:
    """Named, typed and complete bar columns; one output row per raw row."""
    df = normalise_columns(raw)
    schema_notes(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}

    def number(name):
        if name not in types:
            if name == "adj_close":
                return number("close")
            return F.lit(None).cast("double")
        return parse_number(F.col(f"`{name}`"), types[name])

    if "_seq" not in types:
        raise DataError("the rows need an input order, column _seq (see with_order)")
    return df.select(
        F.upper(F.trim("ticker")).alias("ticker"),
        parse_date(F.col("date"), types["date"]).alias("date"),
        *(number(c).alias(c) for c in BAR_COLUMNS),
        "_seq",
    )


def daily_candidates(raw: DataFrame) -> DataFrame:
    """One row per (ticker, date) from its last copy, with rule flags and copy counts.

    A NULL date is kept as a group of its own so that unreadable rows are still counted.
    """
    rows = standardise(raw)
    last = rows.groupBy("ticker", "date").agg(
        F.count("*").alias("copies"),
        *(F.max_by(c, "_seq").alias(c) for c in BAR_COLUMNS),
    )
    missing = F.col("adj_close").isNull()
    nonpositive = F.lit(False)
    for price in PRICES:
        nonpositive = nonpositive | is_true(F.col(price) <= 0)
    dated = F.col("date").isNotNull()
    kept = dated & ~missing & ~nonpositive
    return last.select(
        "*",
        dated.alias("is_dated"),
        (dated & missing).alias("is_missing"),
        (dated & ~missing & nonpositive).alias("is_nonpositive"),
        (kept & is_true(F.col("high") < F.col("low"))).alias("is_inconsistent"),
        (kept & is_true(F.col("volume") < 0)).alias("is_negative_volume"),
        kept.alias("is_kept"),
    )


def clean_bars(candidates: DataFrame) -> DataFrame:
    """The surviving bars, with impossible high/low pairs and volumes blanked."""
    return candidates.where("is_kept").select(
        "ticker", "date", "open",
        F.when(~F.col("is_inconsistent"), F.col("high")).alias("high"),
        F.when(~F.col("is_inconsistent"), F.col("low")).alias("low"),
        "close", "adj_close",
        F.when(~F.col("is_negative_volume"), F.col("volume")).alias("volume"),
    )


def calendar_gaps(bars: DataFrame) -> DataFrame:
    """Per ticker: steps between consecutive bars longer than five calendar days."""
    step = F.datediff("date", F.lag("date").over(ticker_window()))
    return (
        bars.select("ticker", (step > MAX_QUIET_DAYS).alias("is_gap"))
        .groupBy("ticker")
        .agg(F.count_if("is_gap").alias("calendar_gaps_over_5_days"))
    )


def cleaning_report(
    candidates: DataFrame, notes: list[str] | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Per-ticker counters; each row is attributed to the first rule that removes it.

    `rows_out` counts bars inside [start, end]; everything else describes the untrimmed
    input. One window (for the gaps) and one aggregation, both on the ticker.
    """
    # Non-kept rows carry a NULL key, so LAST_VALUE over them skips to the previous bar.
    kept_date = F.when(F.col("is_kept"), F.col("date"))
    before = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.datediff(kept_date, F.last(kept_date, ignorenulls=True).over(before)) > MAX_QUIET_DAYS
    inside = F.col("is_kept") & _in_range(F.col("date"), start, end)
    note_array = F.array(*(F.lit(n) for n in notes or [])).cast("array<string>")
    return (
        candidates.withColumn("is_gap", gap)
        .groupBy("ticker")
        .agg(
            F.sum("copies").alias("rows_in"),
            F.count_if(inside).alias("rows_out"),
            F.sum(F.when(F.col("is_dated"), F.col("copies") - 1).otherwise(0)).alias(COUNTERS[0]),
            F.count_if("is_missing").alias(COUNTERS[1]),
            F.count_if("is_nonpositive").alias(COUNTERS[2]),
            F.count_if("is_inconsistent").alias(COUNTERS[3]),
            F.count_if("is_negative_volume").alias(COUNTERS[4]),
            F.count_if("is_gap").alias(COUNTERS[5]),
            F.min(kept_date).alias("first_date"),
            F.max(kept_date).alias("last_date"),
        )
        .withColumn("notes", note_array)
    )


def _in_range(date: Column, start: str | None, end: str | None) -> Column:
    inside = F.lit(True)
    if start:
        inside = inside & (date >= F.lit(str(start)).cast("date"))
    if end:
        inside = inside & (date <= F.lit(str(end)).cast("date"))
    return inside


def trim(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keep [start, end], both ends included."""
    return bars.where(_in_range(F.col("date"), start, end))


def enough_history(bars: DataFrame, min_rows: int) -> DataFrame:
    """Drop tickers with fewer than `min_rows` bars.

    Counting over the ticker partition (at most one row per calendar day) leaves the data
    hashed by ticker, which the feature windows then reuse without another exchange.
    """
    n = F.count("*").over(Window.partitionBy("ticker"))
    return bars.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


def restrict_universe(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """The configured tickers only; the list comes from parameters, not from data."""
    return bars.where(F.col("ticker").isin(list(tickers))) if tickers else bars


def required_tickers(params: DataParams, market_enabled: bool) -> list[str]:
    """Universe plus, when market features are on, the market ticker."""
    names = params.universe()
    if names and market_enabled and params.market() not in names:
        names.append(params.market())
    return names


def universe_status(bars: DataFrame, requested: list[str]) -> DataFrame:
    """Which requested tickers have data; `missing` ones have no bar at all."""
    spark = bars.sparkSession
    wanted = spark.createDataFrame([(t,) for t in requested], "ticker string")
    have = bars.groupBy("ticker").agg(F.count("*").alias("bars"))
    return wanted.join(have, "ticker", "left").select(
        "ticker",
        F.coalesce("bars", F.lit(0)).alias("bars"),
        F.when(F.col("bars").isNull(), "missing").otherwise("ok").alias("status"),
    )


def ingest_manifest(report: DataFrame, params: DataParams, requested: list[str]) -> DataFrame:
    """One row per requested ticker: status, row count, reason for failure, counters."""
    if requested:
        wanted = report.sparkSession.createDataFrame([(t,) for t in requested], "ticker string")
        report = wanted.join(report, "ticker", "left")
    rows = F.coalesce("rows_out", F.lit(0))
    short = rows < params.min_rows
    reason = F.when(F.col("rows_in").isNull(), F.lit("no rows in the source")).otherwise(
        F.concat(
            F.lit("only "), rows.cast("string"),
            F.lit(f" clean bars, {params.min_rows} needed"),
        )
    )
    return report.select(
        "ticker",
        F.when(F.col("rows_in").isNull(), "absent").otherwise("loaded").alias("action"),
        F.when(short, "failed").otherwise("ok").alias("status"),
        rows.alias("rows"),
        F.when(short, reason).alias("error"),
        F.lit(params.source).alias("source"),
        F.lit(params.start).cast("string").alias("start"),
        F.lit(params.end).cast("string").alias("end"),
        "rows_in", *COUNTERS, "first_date", "last_date", "notes",
    )


@dataclass(frozen=True)
class Ingested:
    bars: DataFrame
    manifest: DataFrame

    def require_usable(self, tickers: list[str]) -> Ingested:
        """Fail only when not one modelling ticker is left (runs one small job)."""
        usable = self.manifest.where("status = 'ok'")
        if tickers:
            usable = usable.where(F.col("ticker").isin(list(tickers)))
        if usable.isEmpty():
            raise DataError("not one modelling ticker passed the ingest checks (see the manifest)")
        return self


def ingest(
    raw: DataFrame, params: DataParams, market_enabled: bool = True,
    keep: Callable[[DataFrame], DataFrame] = lambda candidates: candidates,
) -> Ingested:
    """Clean, trim and gate a raw universe; failing tickers are reported, not fatal.

    Report and bars both come from the daily candidates; `keep` may write them to a table first, so that
    the raw rows are read once.
    """
    requested = required_tickers(params, market_enabled)
    notes = schema_notes([tidy_name(c) for c in raw.columns])
    candidates = keep(restrict_universe(daily_candidates(raw), requested))
    report = cleaning_report(candidates, notes, params.start, params.end)
    bars = enough_history(trim(clean_bars(candidates), params.start, params.end), params.min_rows)
    return Ingested(bars, ingest_manifest(report, params, requested))
