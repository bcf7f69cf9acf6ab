"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run of (digest, best row, count) records, one per distinct text.
Round after round `fan_in` runs meet, sorted by digest, and are merged: equal digests become one
record that keeps the best row and the sum of the counts. A run holds each digest once, so a text
with a third of all rows enters the first round as one record per run. Within a round the records
are also dealt by digest range, so that the last merge is as parallel as the first. The winners go
back down to the runs, not to all rows at once, so no join meets a hot text with all its copies.

Verified: records are merged only if SHA-256, the byte length and an independent 64-bit hash of the
normalised text agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, fresh, parallelism, stored, table, text_of

RUNS = 64     # runs before the first round; more input partitions share them
FAN_IN = 4    # runs merged in a round, so 64 runs take three rounds
_KEY = ["sha", "n_bytes", "check"]
#: More code points first, then a known and smaller doc_id, then the earlier row.
_RANK = "struct(n_points, doc_id is not null, ~doc_id, ~row_id)"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One narrow record per row: its identity, original length and the digest of its normalised text."""
    row = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row_id"),
        F.length(text_of(text)).cast("long").alias("n_points"),
        normalised(text_of(text)).alias("norm"),
    )
    return row.select(
        "doc_id", "row_id", "n_points", F.sha2("norm", 256).alias("sha"),
        F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"),
        F.pmod(F.hash(F.shiftright("row_id", 33)), F.lit(RUNS)).alias("run"),
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """Merge `fan_in` neighbouring runs each; runs are sorted by digest before and after."""
    n = parallelism(runs.sparkSession)
    met = runs.withColumn("run", F.expr(f"run div {fan_in}")).withColumn("range", F.pmod(F.col("check"), F.lit(n)))
    return (
        met.repartition(n, "range", "run").sortWithinPartitions("range", "run", *_KEY)
        .groupBy("range", "run", *_KEY)
        .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        .drop("range")
    )


def winners(rows: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(first runs, the one merged run): digest, best row and number of rows."""
    first = rows.groupBy("run", *_KEY).agg(F.max(F.expr(_RANK)).alias("best"), F.count(F.lit(1)).alias("n"))
    merged, left = first, RUNS
    while left > 1:
        merged, left = merge_round(merged, fan_in), -(-left // fan_in)
    return first, merged.drop("run")


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per input row: doc_id, row_id, keep_id, group_size, kept, text_sha256.

    `docs` is any table Spark reads the same way twice. A null text counts as empty; all empty texts are
    one group. A null doc_id loses against known ones and is kept only if a group has no other. Of rows
    alike in text and doc_id one is kept. An empty table gives an empty result; other columns are not read.
    """
    rows = stored(digests(docs, text, doc_id))
    first, merged = winners(rows)
    down = first.select("run", *_KEY).join(merged, _KEY)
    return rows.join(down, ["run", *_KEY]).select(
        "doc_id", "row_id", F.expr("~best.col3").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row_id") == F.expr("~best.col4")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    (row,) = fresh(docs, "row_id")
    gone = decisions(docs, text, doc_id).where("not kept").select(F.col("row_id").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)


def op2_exact_dedup(spark, sf_dir):
    return decisions(table(spark, sf_dir, "documents")).drop("row_id")


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, length(t) as points, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from d)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept, text_sha256
from n window w as (partition by text_sha256 order by points desc, doc_id)
"""
