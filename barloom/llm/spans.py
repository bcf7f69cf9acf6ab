"""Where a regular expression matches, in DataFrame operations only.

Spark has matches and the gaps between them, but no positions. A match starts after all gaps and matches
before it, so positions are running sums of lengths. They are built in blocks of `BLOCK`, since an array
that grows by one element is copied each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh

BLOCK = 256
SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"


def add_spans(df: DataFrame, text: str, pattern: str | Column, into: str, gate: Column | None = None) -> DataFrame:
    """Add `into`: array of (start, end, hit), leftmost non-overlapping, code points, end exclusive.

    `text` must not be null. `gate`: a cheap condition without which there is no match. Matches must not be empty.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    hits, gaps, sums, starts = fresh(df, f"{into}_hits", f"{into}_gaps", f"{into}_sums", f"{into}_starts")
    none = F.array().cast("array<string>")
    out = df.withColumn(hits, F.when(F.lit(True) if gate is None else gate, F.regexp_extract_all(text, regex, F.lit(0))).otherwise(none))
    out = out.withColumn(gaps, F.when(F.size(hits) > 0, F.split(text, regex, -1)).otherwise(none))

    def total(of: str) -> str:
        return f"aggregate(slice({of}, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + length(x))"

    out = out.withColumn(sums, F.expr(f"if(size({hits}) = 0 or size({gaps}) = 0, cast(array() as array<bigint>), transform(sequence(0, (size({hits}) - 1) div {BLOCK}), b -> {total(hits)} + {total(gaps)}))"))
    out = out.withColumn(starts, F.expr(f"transform({sums}, (s, b) -> aggregate(slice({sums}, 1, b), 0L, (a, x) -> a + x))"))
    at = f"cast(b * {BLOCK} + i as int)"
    begin, end = f"acc.upto + length({gaps}[{at}])", f"acc.upto + length({gaps}[{at}]) + length({hits}[{at}])"
    return out.withColumn(into, F.expr(
        f"flatten(transform({starts}, (s, b) -> aggregate(sequence(0, least({BLOCK}, size({hits}) - b * {BLOCK}) - 1),"
        f" named_struct('upto', s, 'out', cast(array() as {SPAN})),"
        f" (acc, i) -> named_struct('upto', {end}, 'out', concat(acc.out, array(named_struct('start', {begin}, 'end', {end}, 'hit', {hits}[{at}])))),"
        f" acc -> acc.out)))")).drop(hits, gaps, sums, starts)


def labelled(spans: str, kind: str) -> str:
    """SQL: the spans as strings kind:start:end."""
    return f"transform({spans}, x -> concat_ws(':', '{kind}', cast(x.start as string), cast(x.end as string)))"
