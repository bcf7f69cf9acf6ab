"""Sharding: longest-processing-time scheduling of groups that must stay together.

LPT takes groups from the largest to the smallest and gives each to the least loaded shard, found by
a heap. It needs every group on its own only while a group is large beside a shard. So groups of at
least 1/`GRAIN` of all bytes (there are at most `GRAIN` of them, whatever the input) are scheduled one
by one, and smaller ones in hashed bundles: four tiers of `GRAIN`/4 bundles, each tier with a sixteenth
of the bytes of the one before. The last bundles LPT deals are thus a few groups each and level the
shards. What passes through the driver are at most 2 x `GRAIN` (key, size) pairs; rows then find their
shard in two broadcast maps of that bound, so no row of a hot group is moved.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, stored, table, text_of

SHARDS = 8
GRAIN = 8192   # most groups scheduled one by one, and most bundles of the others
BLOCKS = 64    # blocks of a shard that are numbered side by side


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """LPT: items by falling size (ties by key), each to the least loaded shard (ties by number)."""
    heap = [(0, k) for k in range(shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        placed[key] = k
        heapq.heappush(heap, (load + size, k))
    return placed


def _bundle():
    """Bundle of a group, from its digest: tier 1 with chance 1/16, tier 2 with 1/256, and so on."""
    h = F.xxhash64("group")
    tier = F.when(h.bitwiseAND(F.lit(15)) != 0, 0).when(h.bitwiseAND(F.lit(255)) != 0, 1).when(h.bitwiseAND(F.lit(4095)) != 0, 2).otherwise(3)
    return F.concat_ws(":", tier.cast("string"), F.pmod(F.shiftright(h, 12), F.lit(GRAIN // 4)).cast("string"))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Add `shard` to a stored table with columns group (string, not null) and size (long, positive).

    All rows of a group get one shard. No rows give no rows.
    """
    spark = rows.sparkSession
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).head()["n"]
    least = total / GRAIN
    items = groups.select(F.when(F.col("size") >= least, F.col("group")).alias("group"), F.when(F.col("size") < least, _bundle()).alias("bundle"), "size")
    placed = longest_first(
        [(f"g{r['group']}" if r["group"] is not None else f"b{r['bundle']}", r["size"])
         for r in items.groupBy("group", "bundle").agg(F.sum("size").alias("size")).collect()], shards)

    def small_map(kind):
        found = [(key[1:], k) for key, k in placed.items() if key[0] == kind]
        return F.broadcast(spark.createDataFrame(found, "at string, shard int"))  # at most GRAIN rows

    heavy = small_map("g").select(F.col("at").alias("group"), F.col("shard").alias("own"))
    light = small_map("b").select(F.col("at").alias("bundle"), F.col("shard").alias("shared"))
    return (
        rows.withColumn("bundle", _bundle()).join(heavy, "group", "left").join(light, "bundle", "left")
        .withColumn("shard", F.coalesce("own", "shared")).drop("bundle", "own", "shared")
    )


def slots(rows: DataFrame, order: str) -> DataFrame:
    """Add `slot`, gapless from 0 in every shard: blocks are numbered side by side, then moved by their offset."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(order), F.lit(BLOCKS)))
    sizes = dealt.groupBy("shard", "block").count()
    before = sizes.selectExpr("shard", "block", "coalesce(sum(count) over (partition by shard order by block rows between unbounded preceding and 1 preceding), 0) as before")
    numbered = dealt.selectExpr("*", f"row_number() over (partition by shard, block order by {order}) - 1 as at")
    return numbered.join(F.broadcast(before), ["shard", "block"]).withColumn("slot", F.col("before") + F.col("at")).drop("block", "at", "before")  # shards x BLOCKS rows


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per input row: doc_id, row_id, size, text_crc32, shard, slot; equal texts share a shard.

    Size is the UTF-8 length plus one. A null text counts as empty and shares the group of empty texts;
    a null doc_id is carried along; repeated rows get a slot each. One text may outweigh a fair share:
    its shard is then larger, and the others stay near equal. Other columns are not read.
    """
    t = text_of(text)
    rows = stored(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.sha2(t, 256).alias("group"),
    ))
    return slots(assign(rows, shards), "row_id").drop("group")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents themselves, one folder per shard."""
    row, shard = fresh(docs, "row_id", "shard")
    placed = shard_documents(docs, shards).select(F.col("row_id").alias(row), F.col("shard").alias(shard))
    docs.withColumn(row, F.monotonically_increasing_id()).join(placed, row).drop(row).write.partitionBy(shard).parquet(path)


def op3_sharding(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents")).drop("row_id")
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
