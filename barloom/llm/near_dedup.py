"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check, classes.

A document is the set of its five-word shingles. Every shingle owns a region of height (weight) times rank, into which
darts fall as a Poisson process driven by hashes, so the same shingle sees the same darts in every document. A dart under
the shingle's weight hits a coordinate of the signature; the earliest dart (lowest rank) of each coordinate stays. Darts
are thrown in cells of rising rank until every coordinate is hit, about k*ln(k) darts a document whatever its size. Two
documents agree on a coordinate with the probability of their weighted Jaccard similarity. All weights are 1 here, however
often a shingle occurs: then that is the similarity of the sets, by which links are defined and verified.

Bands of the signature are joined as follows. Equal texts are one node. In each bucket of a band all members are compared
with one leader, so a bucket gives as many pairs as members. Pairs are verified by exact Jaccard similarity of their
shingle sets; linked nodes are contracted to components. That is repeated with another leader, and only for buckets whose
members are still in different components. What is then left are buckets whose components stay apart. Their members are
cut into blocks of bounded size and compared block by block, a block pair being one matrix product inside a task; it
returns only the links that join components. So no link between candidates is lost, and pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, map_batches, stored, table, text_of, text_ranges


@dataclass(frozen=True)
class NearRules:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4             # coordinates of a band: a pair at 0.8 is missed with chance 3e-6
    leader_rounds: int = 2    # rounds of one leader a bucket before the members that are left are compared in blocks
    block_items: int = 100_000 # shingles of a block of members, each member counting for 64 at least
    seed: int = 7

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word; forgets all words when `most` are known, which changes speed only."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle hash, occurrences), sorted; words are runs of non-space in ASCII's sense.

    A text of fewer words than a shingle is one shingle of all its words; a text without words has none.
    """
    known, hashes, sizes = _word_hashes(), [], []
    for text in texts:
        w = text.encode("utf-8", "surrogatepass").split()
        hashes += map(known.__getitem__, w)
        sizes.append(len(w))
    h, n = np.array(hashes, np.uint64), np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    rolled = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):  # words beyond the document's end add nothing: such shingles only stay for short texts
            ahead = np.zeros(len(h), np.uint64)
            ahead[:len(h) - k] = h[k:]
            inside = place + k < np.repeat(n, n)
            rolled = mix(rolled * _GOLD + np.where(inside, ahead + np.uint64(k + 1), np.uint64(0)))
    whole = (place + words <= np.repeat(n, n)) | (place == 0)
    doc, rolled = doc[whole], rolled[whole]
    order = np.lexsort((rolled, doc))
    doc, rolled = doc[order], rolled[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (rolled[1:] != rolled[:-1])
    at = np.flatnonzero(first)
    return doc[at], rolled[at], np.diff(np.append(at, len(doc)))


#: Ranks are cut into cells [0, 1/16), [1/16, 1/8), ... [1/2, 1), [1, 2), [2, 3) ...: none holds more than one dart on average.
_FINE = 5
#: Poisson quantiles by cell width.
_POISSON = {w: np.cumsum([np.exp(-w) * w ** k / np.prod(range(1, k + 1), dtype=float) for k in range(16)]) for w in [2.0 ** -k for k in range(_FINE)]}


def _cell(c: int) -> tuple[float, float]:
    """(begin, width) of cell c."""
    if c == 0:
        return 0.0, 2.0 ** (1 - _FINE)
    if c < _FINE:
        return 2.0 ** (c - _FINE), 2.0 ** (c - _FINE)
    return float(c - _FINE + 1), 1.0


def signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, k: int, seed: int) -> np.ndarray:
    """DartMinHash: (docs, k) dart identities; rows of documents without items stay 0. Weights are positive numbers."""
    best = np.full(docs * k, np.inf)
    name = np.zeros(docs * k, np.uint64)
    if not len(doc):
        return name.reshape(docs, k)
    # The region of an item is a stack of layers of height 1; the last is cut by the weight.
    layers = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    with np.errstate(over="ignore"):
        base = mix(item[at] + mix(layer.astype(np.uint64) * _GOLD + np.uint64(seed)))
    owner, height = doc[at], weight[at] - layer
    open_docs = np.bincount(doc, minlength=docs) > 0
    c = 0
    while len(base):
        begin, width = _cell(c)
        with np.errstate(over="ignore"):
            h = base + np.uint64(c + 1) * _GOLD
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
            hit = np.flatnonzero(h >= np.uint64(_POISSON[width][0] * 2.0 ** 64))
            h = h[hit]
            each = np.searchsorted(_POISSON[width], (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53, side="right")
            src = np.repeat(np.arange(len(hit)), each)
            number = np.arange(len(src)) - np.repeat(np.cumsum(each) - each, each)
            ident = mix(h[src] + (number + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            high = mix(ident ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        at = hit[src]
        rank = begin + width * ((ident >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
        under = ((high >> np.uint64(32)).astype(np.float64) * 2.0 ** -32) < height[at]
        key = (owner[at] * k + (high % np.uint64(k)).astype(np.int64))[under]
        rank, ident = rank[under], ident[under]
        np.minimum.at(best, key, rank)
        first = best[key] == rank
        name[key[first]] = ident[first]
        # What is still to come lies at higher ranks: a document with all coordinates hit is done.
        now = open_docs & ~np.isfinite(best.reshape(docs, k)).all(axis=1)
        if now.sum() < open_docs.sum():
            open_docs = now
            live = open_docs[owner]
            base, owner, height = base[live], owner[live], height[live]
        c += 1
    return name.reshape(docs, k)


def bands_of(sig: np.ndarray, rules: NearRules) -> np.ndarray:
    """(docs, bands) keys."""
    cut = sig.reshape(len(sig), rules.bands, rules.rows)
    key = np.zeros(cut.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rules.rows):
            key = mix(key * _GOLD + cut[:, :, r])
    return key


def sketch(docs: DataFrame, rules: NearRules, text: str, doc_id: str) -> DataFrame:
    """Per row: doc_id, row_id, node (digest of the text), n_shingles, bands (empty without shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts, keys = [np.zeros(0, np.int64)], [np.zeros((0, rules.bands), np.uint64)]
            for a, b in text_ranges(texts):
                doc, item, _ = shingles(texts[a:b], rules.words)
                sig = signatures(doc, item, np.ones(len(doc)), b - a, rules.coordinates, rules.seed)
                counts.append(np.bincount(doc, minlength=b - a))
                keys.append(bands_of(sig, rules))
            n, key = np.concatenate(counts), np.concatenate(keys).view(np.int64)
            some = n > 0
            ends = np.concatenate([[0], np.cumsum(some * rules.bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].ravel()))],
                                             names=["doc_id", "row_id", "node", "n_shingles", "bands"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
                       F.substring(F.sha2(text_of(text), 256), 1, 32).alias("node"), text_of(text).alias("text"))
    return map_batches(rows, run, "doc_id bigint, row_id bigint, node string, n_shingles bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, rules: NearRules, text: str) -> DataFrame:
    """(node, items): sorted shingle hashes of the texts whose node is wanted; one row per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_ranges(texts):
                doc, item, _ = shingles(texts[a:b], rules.words)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(item.view(np.int64)))], names=["node", "items"])

    texts = docs.select(F.substring(F.sha2(text_of(text), 256), 1, 32).alias("node"), text_of(text).alias("text"))
    one = nodes.select("node", "row_id")
    with_row = texts.withColumn("row_id", F.monotonically_increasing_id()).join(one.select("row_id"), "row_id", "left_semi").drop("row_id")
    return map_batches(with_row, run, "node string, items array<bigint>")


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The (a, b) pairs whose shingle sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            lv, lo = left.values.to_numpy(), left.offsets.to_numpy()
            rv, ro = right.values.to_numpy(), right.offsets.to_numpy()
            good = [_jaccard(lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]]) >= rules.similarity for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    return map_batches(pairs.join(right, "b").join(left, "a").select("a", "b", "a_items", "b_items"), run, "a string, b string")


def _parts(members: pa.StructArray) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    items = members.field("items")
    return members.field("node").to_pylist(), members.field("comp").to_pylist(), items.flatten().to_numpy(), np.diff(items.offsets.to_numpy())


_COLUMNS = 4096  # items multiplied at once


def block_links(rules: NearRules):
    """Batches of (one, two), lists of (node, comp, items), to links (a, b) that join components of the two lists."""
    def of(one: pa.StructArray, two: pa.StructArray) -> Iterator[tuple[str, str]]:
        (an, ac, ai, al), (bn, bc, bi, bl) = _parts(one), _parts(two)
        _, number, times = np.unique(np.concatenate([ai, bi]), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # an item in one text only adds to no overlap
        column = np.full(len(times), -1)
        column[shared] = np.arange(len(shared))
        a_row, a_col = np.repeat(np.arange(len(al)), al), column[number[:len(ai)]]
        b_row, b_col = np.repeat(np.arange(len(bl)), bl), column[number[len(ai):]]

        def matrix(row: np.ndarray, col: np.ndarray, height: int, begin: int) -> np.ndarray:
            m = np.zeros((height, _COLUMNS), np.float32)
            own = (col >= begin) & (col < begin + _COLUMNS)
            m[row[own], col[own] - begin] = 1
            return m

        both = np.zeros((len(al), len(bl)))
        for begin in range(0, len(shared), _COLUMNS):
            both += matrix(a_row, a_col, len(al), begin) @ matrix(b_row, b_col, len(bl), begin).T
        alike = both / np.maximum(1, al[:, None] + bl[None, :] - both) >= rules.similarity
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while c in root:
                c = root[c]
            return c

        for i, j in np.argwhere(alike):
            x, y = find(ac[i]), find(bc[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                yield an[i], bn[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link for k in range(batch.num_rows) for link in of(batch.column(0)[k].values, batch.column(1)[k].values)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["a", "b"])

    return run


def blockwise(open_: DataFrame, nodes: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Links (a, b) between components that share a bucket; `open_` has (node, band, key, comp)."""
    sized = open_.join(nodes.select("node", "n_shingles"), "node")
    bulk = sized.groupBy("band", "key").agg(
        F.ceil(F.sum(F.greatest("n_shingles", F.lit(64))) / rules.block_items).cast("int").alias("blocks"),
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    # Buckets of several bands often have the same members: one of them is enough.
    bulk = bulk.groupBy("n", "x", "y", "blocks").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "blocks")
    dealt = sized.join(bulk, ["band", "key"]).select("band", "key", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node", "comp")
    member = F.struct("node", "comp", "items")
    blocks = dealt.join(sets, "node").groupBy("band", "key", "block").agg(
        F.collect_list(member).alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    one = blocks.select("band", "key", "block", F.col("members").alias("one"), "lo", "hi")
    two = blocks.select("band", "key", F.col("block").alias("block2"), F.col("members").alias("two"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    mixed = "block <= block2 and (lo <> hi or lo2 <> hi2 or lo <> lo2)"
    met = one.join(two, ["band", "key"]).where(mixed).select("one", "two")
    return map_batches(met, block_links(rules), "a string, b string")


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after joining components along links (a, b) of nodes: each round every component hooks to its least
    neighbour, hooks are followed twice, and links within a component vanish."""
    def between(at: DataFrame, pairs: DataFrame) -> DataFrame:
        x = at.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        y = at.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        return pairs.join(x, "a").join(y, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()

    edges = stored(between(labels, links))
    moved = None  # component at the start -> component now
    while not edges.isEmpty():
        hook = edges.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("to"))  # the greater end hooks to its least lesser neighbour
        for _ in range(2):
            then = hook.select(F.col("c").alias("to"), F.col("to").alias("further"))
            hook = hook.join(then, "to", "left").select("c", F.coalesce("further", "to").alias("to"))
        hook = stored(hook)
        if moved is None:
            moved = hook
        else:
            onward = hook.select(F.col("c").alias("to"), F.col("to").alias("further"))
            fresh_ones = hook.join(moved.select("c"), "c", "left_anti")
            moved = stored(moved.join(onward, "to", "left").select("c", F.coalesce("further", "to").alias("to")).unionByName(fresh_ones))
        now = edges.select("a").union(edges.select("b")).distinct().join(hook, F.col("a") == F.col("c"), "left").select(F.col("a").alias("node"), F.coalesce("to", "a").alias("comp"))
        edges = stored(between(stored(now), edges))
    if moved is None:
        return labels
    return stored(labels.join(moved, labels["comp"] == moved["c"], "left").select("node", F.coalesce("to", "comp").alias("comp")))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: NearRules = NearRules()) -> DataFrame:
    """Per row: doc_id, row_id, class_id, class_size, kept.

    A class is a set of documents connected by links of similarity >= `rules.similarity`; its class_id is its smallest
    doc_id, and that document is kept, of several rows with that id one. Equal texts are in one class. A text of fewer words than a shingle
    is one shingle; a null text counts as empty, and texts without words are each a class of their own. A null doc_id loses
    against known ones; a class of such rows has a null class_id. Texts are read whole. An empty table gives an empty result.
    `docs` is any table Spark reads the same way twice; other columns are not read.
    """
    rows = stored(sketch(docs, rules, text, doc_id))
    nodes = stored(rows.where("n_shingles > 0").groupBy("node").agg(F.min("row_id").alias("row_id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = stored(buckets.join(shared, ["band", "key"]))
    involved = members.select("node").distinct()
    sets = stored(shingle_sets(docs, nodes.join(involved, "node", "left_semi"), rules, text))
    labels = stored(involved.select("node", F.col("node").alias("comp")))

    def still_open(labels: DataFrame) -> DataFrame:
        placed = members.join(labels, "node")
        apart = placed.groupBy("band", "key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band", "key")
        return stored(placed.join(apart, ["band", "key"]))

    open_ = still_open(labels)
    for turn in range(rules.leader_rounds):
        # Another leader each turn: the member whose hash with the turn is least.
        order = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("leader"), F.col("comp").alias("leads"))
        lead = open_.groupBy("band", "key").agg(F.min(order).alias("l")).select("band", "key", "l.leader", "l.leads")
        pairs = open_.join(lead, ["band", "key"]).where("comp <> leads").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
        labels = contract(labels, verified(stored(pairs.distinct()), sets, rules))
        open_ = still_open(labels)
    if not open_.isEmpty():
        labels = contract(labels, stored(blockwise(open_, nodes, sets, rules)))

    known = rows.join(labels, "node", "left")
    lone = F.when(F.col("n_shingles") == 0, F.concat(F.lit("row "), F.col("row_id").cast("string"))).otherwise(F.coalesce("comp", "node"))
    known = stored(known.select("doc_id", "row_id", lone.alias("comp")))
    heads = known.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_id")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return known.join(heads, "comp").select("doc_id", "row_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("head.row_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: NearRules = NearRules()) -> DataFrame:
    """One row of each class, with all columns."""
    (row,) = fresh(docs, "row_id")
    gone = classes(docs, text, doc_id, rules).where("not kept").select(F.col("row_id").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(gone, row, "left_anti").drop(row)


def op5_near_dedup(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).drop("row_id")


#: All pairs that share a shingle, then everything reachable: for small tables.
SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) u(i) where len(ws) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as common from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where common::double / (na.n + nb.n - common) >= 0.8),
reach(a, b) as (select a, b from links union select b, a from links union select r.a, l.b from reach r join (select a, b from links union select b, a from links) l on r.b = l.a),
c as (select d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) as class_id from documents d left join reach r on r.a = d.doc_id group by d.doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept from c
"""
