"""Running totals along a sorted value, without sorting a whole group in one task.

Equal values are first merged (map-side), so ties cost nothing. Each group is then cut
into blocks at approximate quantiles of its distinct values, which adapts to any
distribution; totals run inside blocks in parallel and block offsets are added on.
The result is exact: the quantiles only decide where the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import guard

FEWEST_BLOCKS, MOST_BLOCKS = 32, 8192
#: Cut points of all groups together: 64 MB at the most.
MOST_CUTS = 8_000_000


def default_blocks(rows: DataFrame) -> int:
    """As many blocks per group as the session has shuffle partitions, within limits.

    A cluster sized for more data gets finer blocks; the cut points of a group stay a
    small array either way.
    """
    configured = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(FEWEST_BLOCKS, min(configured, MOST_BLOCKS))


def _with_block(rows: DataFrame, value: str, blocks: int) -> DataFrame:
    """Add `_block`: how many of the sorted `_cuts` are below the value.

    A binary search written as one small column per step, all in generated code.
    """
    step = 1
    while step * 2 <= blocks:
        step *= 2
    rows = rows.withColumn("_block", F.lit(0))
    while step:
        rows = rows.withColumn(
            "_block", F.expr(f"if(try_element_at(_cuts, _block + {step}) < `{value}`, _block + {step}, _block)")
        )
        step //= 2
    return rows.drop("_cuts")


def running_totals(
    rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column], blocks: int | None = None
) -> DataFrame:
    """One row per (keys, distinct value) with its sums and the sums before it.

    For each name in `sums` the output has `name`, `name_before` (over smaller values),
    `name_total` (over the group) and `name_below` (at the next smaller value, NULL at the
    smallest), plus `is_largest`.
    """
    blocks = blocks or default_blocks(rows)
    distinct = rows.groupBy(*keys, value).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    shares = [i / blocks for i in range(1, blocks)]
    # One row per group: cut points and group totals. Groups are models, not data.
    cuts = distinct.groupBy(*keys).agg(
        F.percentile_approx(value, shares, max(10_000, 4 * blocks)).alias("_cuts"),
        *(F.sum(n).alias(f"{n}_total") for n in sums),
    )
    # A shuffle on the group alone would send all its values to one task; so cut points travel, and their number is checked.
    everyone = Window.partitionBy(F.lit(1))
    kind = f"array<{distinct.schema[value].dataType.simpleString()}>"
    few = guard(F.count("*").over(everyone) > MOST_CUTS // blocks, "too many groups for running totals: fewer blocks allow more", F.col("_cuts"), kind)
    placed = _with_block(distinct.join(F.broadcast(cuts.withColumn("_cuts", few)), keys, "left"), value, blocks)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_block")
    heads = placed.groupBy(*keys, "_block").agg(
        *(F.sum(n).alias(f"_s_{n}") for n in sums),
        *(F.max_by(n, value).alias(f"_h_{n}") for n in sums),
    ).select(
        *keys, "_block",
        *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums),
        *(F.lag(f"_h_{n}").over(along).alias(f"_n_{n}") for n in sums),
        F.lead("_block").over(along).isNull().alias("_last_block"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(heads, [*keys, "_block"], "left").select(
        *keys, value, *sums,
        *((F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(upto), F.lit(0))).alias(f"{n}_before") for n in sums),
        *(f"{n}_total" for n in sums),
        *(F.coalesce(F.lag(n).over(inside), F.col(f"_n_{n}")).alias(f"{n}_below") for n in sums),
        (F.col("_last_block") & F.lead(value).over(inside).isNull()).alias("is_largest"),
    )
