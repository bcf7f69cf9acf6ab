"""SimHash near-duplicates: meet-in-the-middle ball hashing.

A fingerprint has 64 bits; bit b is set if more than half of a text's shingle hashes have it. Two fingerprints link at
`radius` or fewer differing bits. Every distinct fingerprint emits all variants within half the radius (itself and its 64
one-bit flips for radius 2). Two fingerprints link exactly if they have a variant in common: half of the differing bits lead
from either side to the middle. So a shuffle on variants brings all linked fingerprints together.

Bounded groups: fingerprints are merged first, so one that a third of all documents share is one record. A variant is then
shared by fingerprints within half the radius of it alone, 65 of them at most, whatever the data. They all lie within the
radius of each other, so each is paired with the least of them; that gives as many pairs as members and loses no link of a
component. Pairs of several variants are made distinct, verified by their differing bits, and contracted to components.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import join_by_count, map_batches, stored, table, text_of, text_ranges
from barloom.llm.near_dedup import contract


@dataclass(frozen=True)
class SimRules:
    words: int = 3
    radius: int = 2
    seed: int = 42

    def __post_init__(self):
        if self.radius % 2 or not 0 <= self.radius <= 4:
            raise ValueError("the radius must be 0, 2 or 4: only an even one has a middle")

    def masks(self) -> list[int]:
        """Bits to flip for each variant, as signed 64-bit numbers; the first flips none."""
        flips = itertools.chain.from_iterable(itertools.combinations(range(64), n) for n in range(self.radius // 2 + 1))
        return [m - (1 << 64) if (m := sum(1 << b for b in bits)) >= 1 << 63 else m for bits in flips]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SLICE = 1 << 18  # shingle hashes opened into bits at once


def shingle_hashes(text: bytes, rules: SimRules) -> list[int]:
    """XXH64 of each run of `words` words, repeats included; a shorter text is one shingle, one without words has none."""
    import xxhash

    digest, words = xxhash.xxh64_intdigest, text.translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= rules.words:
        return [digest(line, rules.seed)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    return [digest(line[a:b], rules.seed) for a, b in zip(begin[:1 - rules.words].tolist() if rules.words > 1 else begin.tolist(), end[rules.words - 1:].tolist(), strict=True)]


def majority(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Fingerprint of each document from its hashes; `doc` is sorted. No hashes: zero."""
    ones = np.zeros((docs, 64), np.int64)
    for k in range(0, len(hashes), _SLICE):
        d = doc[k:k + _SLICE]
        bits = np.unpackbits(hashes[k:k + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        ones[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    n = np.bincount(doc, minlength=docs)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: SimRules = SimRules()) -> DataFrame:
    """Per row: doc_id, row_id, fp (the fingerprint as a signed 64-bit number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in text_ranges(texts):
                each = [shingle_hashes(t, rules) for t in texts[a:b]]
                size = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(size.sum()))
                fp = majority(flat, np.repeat(np.arange(b - a), size), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(fp.view(np.int64))], names=["doc_id", "row_id", "fp"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), text_of(text).cast("binary").alias("text"))
    return map_batches(rows, run, "doc_id bigint, row_id bigint, fp bigint")


def links(prints: DataFrame, rules: SimRules = SimRules()) -> DataFrame:
    """Distinct pairs (a, b) of the fingerprints `fp`, enough to join all that link; `prints` has each fingerprint once."""
    masks = ", ".join(f"{m}L" if m > -1 << 63 else "-9223372036854775808L" for m in rules.masks())
    variants = prints.select("fp", F.explode(F.expr(f"transform(array({masks}), m -> fp ^ m)")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    met = variants.withColumn("least", least).where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= rules.radius)


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: SimRules = SimRules()) -> DataFrame:
    """Per row: doc_id, row_id, fp, component_id, component_size.

    A component is what links reach; component_id is its smallest doc_id. Equal fingerprints are one node. A null text counts
    as empty; texts without words have fingerprint zero, which links like any other. A null doc_id loses against known ones;
    a component of such rows has a null component_id. Repeated rows are counted and returned one by one. Texts are read whole.
    An empty table gives an empty result. `docs` is any table Spark reads the same way twice; other columns are not read.
    """
    rows = stored(fingerprints(docs, text, doc_id, rules))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")))
    linked = stored(links(nodes.select("fp"), rules))
    labels = stored(linked.select(F.col("a").alias("node")).union(linked.select("b")).distinct().withColumn("comp", F.col("node")))
    labels = contract(labels, linked)
    # Fingerprints without a link are components of their own; only linked ones are merged.
    placed = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "n", "doc_id", F.coalesce("comp", "fp").alias("comp"))
    heads = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.sum("n").alias("component_size"))
    whole = stored(placed.join(heads, "comp").select("fp", "n", "component_id", "component_size"))
    return join_by_count(rows, whole, "fp", "n").select("doc_id", "row_id", "fp", "component_id", "component_size")


def op13_simhash(spark, sf_dir):
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
