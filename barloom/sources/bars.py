"""Reading and writing bar files: one table for any number of tickers and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.cleaning import BAR_COLUMNS, DataError, tidy_name


def ticker_from_path() -> Column:
    """Ticker of the file a row came from: `ticker=NAME/` folder, else the file stem."""
    path = F.url_decode(F.col("_metadata.file_path"))
    folder = F.regexp_extract(path, r"ticker=([^/]+)/", 1)
    stem = F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)*$", 1)
    return F.upper(F.when(folder != "", folder).otherwise(stem))


def _csv_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, changed, header) of every CSV file, the header being its first line."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"),
                F.col("_metadata.file_block_start").alias("block"))
        .where("block = 0").withColumn("at", F.monotonically_increasing_id())
    )
    return lines.groupBy("path", "changed").agg(F.min_by("value", "at").alias("header"))


def _read_csv(spark: SparkSession, paths: str | list[str], ordered: bool = False, with_path: bool = False) -> DataFrame:
    """All CSV files as text columns, each file by its own header; columns a file lacks are NULL.

    Spark maps columns by position from one file's header, so there is one read per distinct header. Through
    the driver go file names and headers, as in any listing. `ordered` adds `_seq`: later files (by
    change time, then name) and later lines are larger.
    """
    files = sorted(_csv_files(spark, paths).collect(), key=lambda f: (f["changed"], f["path"]))
    if not files:
        raise DataError(f"no CSV file with a header under {paths}")
    by_header: dict[str, list[str]] = {}
    for f in files:
        by_header.setdefault(f["header"], []).append(f["path"])
    numbers = spark.createDataFrame([(f["path"], n) for n, f in enumerate(files)], "_path string, _file long")
    parts = []
    for own in by_header.values():
        rows = spark.read.option("header", True).csv(own)
        rows = rows.toDF(*(tidy_name(c) for c in rows.columns))
        if "ticker" not in rows.columns:
            rows = rows.withColumn("ticker", ticker_from_path())
        if with_path:
            rows = rows.withColumn("_from", F.col("_metadata.file_path"))
        if ordered:
            # Line numbers are counted within a file block; blocks of a file follow each other.
            rows = rows.withColumn("_path", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start"))
            rows = rows.withColumn("_line", F.monotonically_increasing_id()).join(F.broadcast(numbers), "_path")  # one row per file
            digits = F.concat(F.lpad(F.col("_file").cast("string"), 7, "0"), F.lpad(F.col("_block").cast("string"), 12, "0"), F.lpad(F.col("_line").cast("string"), 19, "0"))
            rows = rows.withColumn("_seq", digits.cast("decimal(38,0)")).drop("_path", "_block", "_line", "_file")
        parts.append(rows)
    if any("adj_close" in p.columns for p in parts):  # a file without it stands in with its close, as it would alone
        parts = [p if "adj_close" in p.columns or "close" not in p.columns else p.withColumn("adj_close", F.col("close")) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def file_tickers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, ticker) of every file and ticker in it; a file without a ticker column is named by its path and has one."""
    rows = _read_csv(spark, paths, with_path=True)
    return rows.select(F.col("_from").alias("path"), F.upper(F.trim("ticker")).alias("ticker")).distinct()


def read_vendor_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw CSV of any header spelling and column order, everything still text; ticker from column or path.

    `_seq` is the order of the rows, so that of several copies of a day the last one written wins.
    """
    return _read_csv(spark, paths, ordered=True)


def read_bars(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Cleaned bars with exactly the bar columns; a missing one is an error."""
    found = _read_csv(spark, paths) if fmt == "csv" else spark.read.format(fmt).load(paths)
    missing = [c for c in ("date", *BAR_COLUMNS) if c not in found.columns]
    if missing:
        raise DataError(f"bar files lack the columns {missing}")
    return found.select(
        "ticker", F.col("date").cast("date").alias("date"),
        *(F.col(c).cast("double").alias(c) for c in BAR_COLUMNS),
    )


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store bars. Parquet is range-sorted by ticker and date, so files hold disjoint
    ranges and both predicates prune; CSV gets one folder per ticker for human readers."""
    columns = ["ticker", "date", *BAR_COLUMNS]
    if fmt == "csv":
        bars.select(columns).repartition("ticker").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(path)
    else:
        (
            bars.select(columns).repartitionByRange("ticker", "date")
            .sortWithinPartitions("ticker", "date")
            .write.mode("overwrite").format(fmt).save(path)
        )
