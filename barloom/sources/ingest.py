"""Ingest of vendor files that reads only what changed since the last one.

Beside the bars lies a table of the files they came from: path, size, change time and tickers of each. A listing of the
source is compared with it. A ticker is rebuilt if one of its files is new, changed or gone, from all its present files,
since the last copy of a day may stand in any of them; files of other tickers are not opened. Bars have one folder per
ticker and only those of rebuilt tickers are replaced, so an ingest costs what has changed, not what there is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cleaning
from barloom.params import DataParams
from barloom.sources.bars import file_tickers, read_vendor_csv
from barloom.sources.tables import _exists, remove, stored

BARS = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
_FILES = "path string, size long, changed timestamp, ticker string"


@dataclass(frozen=True)
class Update:
    """What an ingest did: the manifest (one row per ticker) and numbers of files."""

    manifest: DataFrame
    files_read: int
    files_unchanged: int
    files_gone: int


def listing(spark: SparkSession, source: str) -> DataFrame:
    """(path, size, changed) of every CSV file below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(source)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    """The bars of all tickers; empty before the first ingest."""
    if not _exists(spark, f"{out}/bars"):
        return spark.createDataFrame([], BARS)
    return spark.read.schema(BARS).parquet(f"{out}/bars")


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _exists(spark, f"{path}/_SUCCESS") else spark.createDataFrame([], schema)


def update(spark: SparkSession, source: str, out: str, params: DataParams, market_enabled: bool = True) -> Update:
    """Bring the bars below `out` up to date with the files below `source`.

    The manifest's `action` is `loaded` or `absent` as in a whole ingest, `unchanged` for a ticker none of whose files changed,
    `removed` for one whose last file is gone. With other cleaning parameters, use another `out`. A run that is cut short
    leaves the file table as it was, so the next one does the same work again.
    """
    requested = cleaning.required_tickers(params, market_enabled)
    now = stored(listing(spark, source))
    old = stored(_known(spark, f"{out}/files", _FILES))
    facts = ["path", "size", "changed"]
    fresh = now.join(old, facts, "left_anti")
    gone = old.join(now, facts, "left_anti")
    kept = old.join(now, facts, "left_semi")
    fresh_paths = [r["path"] for r in fresh.select("path").collect()]  # names, as in any listing
    found = file_tickers(spark, fresh_paths).join(fresh, "path") if fresh_paths else fresh.withColumn("ticker", F.lit(None).cast("string"))
    found = stored(found.select(*facts, "ticker"))
    touched = stored(found.select("ticker").union(gone.select("ticker")).where("ticker is not null").distinct())
    if requested:
        touched = touched.where(F.col("ticker").isin(requested))
    again = [r["path"] for r in kept.join(touched, "ticker", "left_semi").select("path").distinct().collect()]
    counts = dict(
        files_read=len(fresh_paths) + len(again), files_gone=gone.join(now, "path", "left_anti").select("path").distinct().count(),
        files_unchanged=kept.select("path").distinct().count() - len(again))

    earlier = _known(spark, f"{out}/manifest", _manifest_schema(spark))
    present = stored(found.select("ticker").union(kept.select("ticker")).distinct())
    manifest = earlier.join(touched, "ticker", "left_anti").join(present, "ticker", "left_semi").withColumn("action", F.lit("unchanged"))
    if fresh_paths or again:
        raw = read_vendor_csv(spark, sorted(fresh_paths + again))
        raw = raw.join(touched.select(F.col("ticker").alias("_touched")), F.upper(F.trim("ticker")) == F.col("_touched"), "left_semi")
        candidates = stored(cleaning.daily_candidates(raw))
        notes = cleaning.schema_notes([cleaning.tidy_name(c) for c in raw.columns])
        report = cleaning.cleaning_report(candidates, notes, params.start, params.end)
        bars = cleaning.enough_history(cleaning.trim(cleaning.clean_bars(candidates), params.start, params.end), params.min_rows)
        # A ticker falls into one task's file; several tickers share a task.
        bars.select(*(c.split()[0] for c in BARS.split(", "))).repartition("ticker").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(f"{out}/bars")
        loaded = cleaning.ingest_manifest(report, params, [])
        manifest = manifest.unionByName(loaded)
    lost = touched.join(present, "ticker", "left_anti")
    absent = lost
    if requested:
        wanted = spark.createDataFrame([(t,) for t in requested], "ticker string")
        absent = lost.union(wanted.join(present, "ticker", "left_anti")).distinct()
    known = manifest.select("ticker")
    missing = absent.join(known, "ticker", "left_anti").join(lost.withColumn("was", F.lit(True)), "ticker", "left")
    blank = cleaning.ingest_manifest(spark.createDataFrame([], _report_schema(spark)), params, [])
    filler = missing.select(
        "ticker", F.when(F.col("was"), "removed").otherwise("absent").alias("action"), F.lit("failed").alias("status"), F.lit(0).cast("long").alias("rows"),
        F.lit("no rows in the source").alias("error"), F.lit(params.source).alias("source"), F.lit(params.start).cast("string").alias("start"), F.lit(params.end).cast("string").alias("end"))
    manifest = stored(manifest.unionByName(blank.unionByName(filler, allowMissingColumns=True)))

    # Tickers that are gone, or have too few bars now, must not keep bars of an earlier ingest.
    stale = touched.join(manifest.where("status = 'ok' and action = 'loaded'"), "ticker", "left_anti").collect()
    for r in stale:
        remove(spark, f"{out}/bars/ticker={_escaped(spark, r['ticker'])}")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    kept.select(*facts, "ticker").unionByName(found).write.mode("overwrite").parquet(f"{out}/files")
    return Update(spark.read.schema(manifest.schema).parquet(f"{out}/manifest"), **counts)


def _escaped(spark: SparkSession, ticker: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(ticker)


def _report_schema(spark: SparkSession):
    counters = ", ".join(f"{c} long" for c in cleaning.COUNTERS)
    return f"ticker string, rows_in long, rows_out long, {counters}, first_date date, last_date date, notes array<string>"


def _manifest_schema(spark: SparkSession):
    return cleaning.ingest_manifest(spark.createDataFrame([], _report_schema(spark)), DataParams(), []).schema
