"""Many random forests in one pass over the rows.

All forests of a search (grid points, folds and the final fits) grow together. Forests that differ in depth and number of trees only
grow once, to the largest of both: no draw depends on them, so a shallower tree is the upper levels of a deeper one. As in `boosting`, features
are cut once per training range, rows lie in blocks of bounded size, and a task holds one block and adds up counts per node, feature and bin for
its share of the trees; where a range has several blocks the counts are added by tree. The best split of a node is found where its counts are;
the driver gets splits only. On ranges of several blocks one Spark job grows one level of a batch of trees of all forests; where a range is one
block, its trees grow to the end in the tasks that hold it, all in one job.

What is fitted is what Spark ML's forest fits, without merging leaves that vote alike: Gini impurity over class-weighted counts,
rows drawn with replacement (Poisson), a node sees some of the features. Draws are hashes of the row's date and ticker, or of the node, with the
number of the tree. Counts are whole numbers, so results do not depend on blocks, tasks or their order. The first n trees
are the forest of n.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.boosting import BLOCK_ROWS, binned_blocks, hashing, placed_rows, range_facts, walking
from barloom.operators.logistic import EVERYTHING
from barloom.sources.session import shared_folder

#: Trees of each forest that grow together, where a training range is one block.
BATCH = 50


@dataclass(frozen=True)
class Job:
    """One forest: the ordinals it is trained on (from, to) and its parameters, with Spark ML's defaults."""

    span: tuple[int, int] = EVERYTHING
    trees: int = 20
    depth: int = 5
    least: int = 1
    features: str = "sqrt"

    def seen(self, width: int) -> int:
        """Features a node sees."""
        name = str(self.features)
        if name in ("auto", "sqrt"):
            return int(np.ceil(np.sqrt(width)))
        if name in ("all", "log2", "onethird"):
            return {"all": width, "log2": max(1, int(np.ceil(np.log2(width)))), "onethird": int(np.ceil(width / 3))}[name]
        share = float(name)
        if share <= 0:
            raise ValueError(f"max_features must be positive, not {name}")
        return min(width, int(share) if name.isdigit() else max(1, int(np.ceil(min(share, 1.0) * width))))


@dataclass
class Tree:
    """Nodes by level; `feature` is -1 at leaves, `left` the first of two neighbouring children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    counts: np.ndarray      # drawn rows of each class


@dataclass
class Forest:
    """Trees of one job; none where only one class was seen."""

    trees: list[Tree]
    weights: tuple[float, float]
    prior: float
    rows: int
    width: int

    def first(self, n: int) -> Forest:
        return Forest(self.trees[:n], self.weights, self.prior, self.rows, self.width)

    def table(self) -> tuple | None:
        """What `boosting.score_many` scores with: nodes of all trees one after the other."""
        if not self.trees:
            return None
        sizes = np.array([len(t.feature) for t in self.trees])
        starts = np.cumsum(sizes) - sizes
        weighted = np.concatenate([t.counts for t in self.trees]) * self.weights
        feature, left = np.concatenate([t.feature for t in self.trees]), np.concatenate([t.left + s for t, s in zip(self.trees, starts)])
        depth, inner = 0, starts[feature[starts] >= 0]
        while len(inner):
            depth, below = depth + 1, np.concatenate([left[inner], left[inner] + 1])
            inner = below[feature[below] >= 0]
        return (starts, depth, feature, np.concatenate([t.threshold for t in self.trees]), left, weighted[:, 1] / weighted.sum(axis=1), "mean")


def splitting():
    """Functions for tasks and the driver: (feature, bin, gain, class counts) of trees in heap order, and the splits of a level put into one."""
    def blank(trees, depth):
        shape = (trees, (2 << depth) - 1)
        return np.full(shape, -1, np.int32), np.zeros(shape, np.uint16), np.zeros(shape), np.zeros((*shape, 2), np.int64)

    def put(grown, t, nodes, feature, cut, gain, whole, left):
        """Whether there are any splits."""
        features, bins, gains, counts = (values[t] for values in grown)
        counts[nodes] = whole
        inner = feature >= 0
        k = nodes[inner]
        features[k], bins[k], gains[k] = feature[inner], cut[inner], gain[inner]
        counts[2 * k + 1], counts[2 * k + 2] = left[inner], whole[inner] - left[inner]
        return bool(inner.any())

    return blank, put


def _tasks(seed: int, width: int, cuts: Mapping[int, list[np.ndarray]], forests: Mapping[int, tuple], shares: int):
    """The functions that run in tasks, which hold all they need: executors have no copy of this package.

    `forests` has (span, depth, least rows of a node, features seen, class weights) by number.
    """
    points = {s: np.array([len(c) for c in own]) for s, own in cuts.items()}
    most = {s: int(c.max(initial=0)) + 1 for s, c in points.items()}
    mixed, places, (blank, put) = hashing(seed), walking(), splitting()
    chances = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 20.0)])))

    def unpacked(record):
        span, share, bins, y, key = record
        y = np.frombuffer(y).astype(np.int64)
        return np.frombuffer(bins, np.uint16).reshape(len(y), width), y, np.frombuffer(key, np.int64)

    def drawn(number, bins, y, key):
        """(bins, labels, times drawn) of the rows of a tree."""
        times = np.searchsorted(chances, mixed(key, 1, number), side="right")
        used = np.flatnonzero(times)
        return bins[used], y[used], times[used].astype(float)

    def counted(level, number, m, feature, cut, rows, b, label, times, node=None):
        """(nodes, features seen, counts by class, node, feature, bin) of a level of tree `number`; None without nodes. `node` has those of rows.

        A node with fewer rows than two smallest children stays a leaf; its parent's split gave its counts. `rows` has those of each node.
        """
        size, seen = most[forests[m][0]], forests[m][3]
        nodes = np.zeros(1, np.int64)
        if level:
            parents = np.arange((1 << (level - 1)) - 1, (1 << level) - 1)
            parents = parents[feature[parents] >= 0]
            nodes = np.sort(np.concatenate([2 * parents + 1, 2 * parents + 2]))
            nodes = nodes[rows[nodes] >= 2 * max(forests[m][2], 1)]
        if not len(nodes):
            return None
        chance = mixed((nodes[:, None] * width + np.arange(width)[None, :]).ravel(), 2, number).reshape(len(nodes), width)
        subset = np.sort(np.argsort(chance, axis=1)[:, :seen], axis=1)
        compact = np.full((2 << level) - 1, -1)
        compact[nodes] = np.arange(len(nodes))
        place = compact[places(b, feature, cut, level) if node is None else node]
        inside = np.flatnonzero(place >= 0)
        place, w, c = place[inside], times[inside], label[inside]
        total = np.empty((2, len(nodes), seen, size))
        flat, row, first = b.ravel(), inside * width, (c * len(nodes) + place) * size
        for j, own in enumerate(np.ascontiguousarray(subset.T)):
            total[:, :, j] = np.bincount(first + flat[row + own[place]], w, total.size // seen).reshape(2, len(nodes), size)
        return nodes, subset, total

    def sums(level, start, trees):
        """((forest, tree), counts) of one block; `trees` has (feature, cut, rows of each node) by forest."""
        def run(record):
            rows = unpacked(record)
            own = [m for m in trees if forests[m][0] == record[0]]
            for t in range(record[1], max((len(trees[m][0]) for m in own), default=0), shares):
                sample = drawn(start + t, *rows)
                for m in own:
                    found = counted(level, start + t, m, *(values[t] for values in trees[m]), *sample) if t < len(trees[m][0]) else None
                    if found is not None:
                        yield (m, t), found
        return run

    def whole(sizes):
        """(forest, tree, splits of each level as in `best`) of a block that is a training range; `sizes` has the number of trees by forest."""
        def run(record):
            rows = unpacked(record)
            own = [m for m in sizes if forests[m][0] == record[0]]
            for t in range(record[1], max((sizes[m] for m in own), default=0), shares):
                sample = drawn(t, *rows)
                for m in own:
                    if t >= sizes[m]:
                        continue
                    made, grown = [], blank(1, forests[m][1])
                    tree, node = [values[0] for values in grown], np.zeros(len(sample[0]), np.int64)
                    for level in range(forests[m][1]):
                        found = counted(level, t, m, tree[0], tree[1], tree[3].sum(axis=1), *sample, node)
                        if found is None:
                            break
                        made.append(best(((m, t), found))[2:])
                        if not put(grown, 0, *made[-1]):
                            break
                        node = places(sample[0], tree[0], tree[1], 1, node)
                    yield m, t, made
        return run

    def added(a, b):
        return a[0], a[1], a[2] + b[2]

    def best(item):
        """(forest, tree, nodes, feature or -1, bin, gain, counts of the node, counts of its left child)"""
        (m, t), (nodes, subset, total) = item
        span, _, least, _, weights = forests[m]
        left = np.cumsum(total, axis=3)
        whole, size = left[:, :, 0, -1], left.shape[3]
        rows = left[0] + left[1]
        ok = (rows >= max(least, 1)) & (rows <= (whole[0] + whole[1] - max(least, 1))[:, None, None])
        ok &= np.arange(size)[None, None, :] < points[span][subset][:, :, None]
        # Gains only where a split is allowed, which is nowhere in the last bin.
        k = np.flatnonzero(ok)
        own = k // (rows.shape[1] * size)
        l0, l1 = left[0].ravel()[k], left[1].ravel()[k]
        a0, a1, b0, b1 = l0 * weights[0], l1 * weights[1], (whole[0][own] - l0) * weights[0], (whole[1][own] - l1) * weights[1]
        w0, w1 = whole[0] * weights[0], whole[1] * weights[1]
        w = w0 + w1
        pure = (a0 * a0 + a1 * a1) / (a0 + a1) + (b0 * b0 + b1 * b1) / (b0 + b1)
        gain = np.full(rows.size, -1.0)
        gain[k] = (pure - ((w0 * w0 + w1 * w1) / w)[own]) / w[own]
        gain, every = gain.reshape(len(nodes), -1), np.arange(len(nodes))
        at = gain.argmax(axis=1)
        slot, cut = np.divmod(at, size)
        most_ = gain[every, at]
        return m, t, nodes, np.where(most_ > 1e-12, subset[every, slot], -1), cut, most_, whole.T, left[:, every, slot, cut].T

    return sums, added, best, whole


def fit_many(rows: DataFrame, jobs: list[Job], balanced: bool = True, seed: int = 42, max_bins: int = 128, block_rows: int = BLOCK_ROWS,
             facts: tuple | None = None) -> list[Forest]:
    """Fit all jobs on rows with date, ticker, features, target and (if spans are used) ordinal; `balanced` weights classes alike.

    `facts` are known `range_facts` of the rows.
    """
    context = rows.sparkSession.sparkContext
    spans = list(dict.fromkeys(j.span for j in jobs))
    placed = placed_rows(rows, spans)
    width, known = facts or range_facts(rows, spans, max_bins)
    facts = {k: known[span] for k, span in enumerate(spans) if span in known}
    out = []
    for job in jobs:
        n, ups, _ = facts.get(spans.index(job.span), (0, 0, []))
        weights = (n / (2.0 * (n - ups)), n / (2.0 * ups)) if balanced and 0 < ups < n else (1.0, 1.0)
        out.append(Forest([], weights, ups / n if n else 0.0, n, width))
    moving = [m for m, f in enumerate(out) if 0 < f.prior < 1]
    if not moving:
        return out
    at = {m: spans.index(jobs[m].span) for m in moving}
    used = sorted(set(at.values()))
    blocks = {s: -(-facts[s][0] // block_rows) for s in used}
    cuts = {s: facts[s][2] for s in used}
    # Trees of a batch are dealt out by number, so that there are some three tasks a core.
    shares = max(1, -(-3 * context.defaultParallelism // sum(blocks.values())))
    batch = max(1, BATCH // max(blocks.values()))
    order = {key: k for k, key in enumerate((s, b, g) for s in sorted(used, key=lambda s: -facts[s][0]) for b in range(blocks[s]) for g in range(shares))}

    def spread(r):
        for g in range(shares):
            yield order[r["span"], r["block"], g], (r["span"], g, bytes(r["bins"]), bytes(r["y"]), bytes(r["key"]))

    # Of forests that differ in depth and number of trees only, one grows for all.
    alike: dict[tuple, list[int]] = {}
    for m in moving:
        alike.setdefault((at[m], jobs[m].least, jobs[m].seen(width)), []).append(m)
    largest = {own[0]: (max(jobs[m].trees for m in own), max(jobs[m].depth for m in own)) for own in alike.values()}
    forests = {m: (at[m], depth, jobs[m].least, jobs[m].seen(width), np.array(out[m].weights)) for m, (_, depth) in largest.items()}
    blank, put = splitting()
    sums, added, best, whole = _tasks(seed, width, cuts, forests, shares)
    state = binned_blocks(placed, cuts, blocks).rdd.flatMap(spread).partitionBy(len(order), lambda k: k).values().persist(StorageLevel.MEMORY_AND_DISK)

    def taken(first, growing):
        """Trees of the batch that starts at `first`, cut to what each forest wants of them."""
        for m, grown in growing.items():
            for other in next(own for own in alike.values() if own[0] == m):
                size = (2 << jobs[other].depth) - 1
                for t in range(min(len(grown[0]), jobs[other].trees - first)):
                    feature, *rest = (values[t][:size] for values in grown)
                    feature = np.where(np.arange(size) < size // 2, feature, -1)
                    out[other].trees.append(_packed(feature, *rest, cuts[at[other]]))

    alone = {m: trees for m, (trees, _) in largest.items() if blocks[at[m]] == 1}
    if alone:
        found: dict[int, list] = {m: [None] * trees for m, trees in alone.items()}
        for m, t, made in state.filter(lambda record: blocks[record[0]] == 1).flatMap(whole(alone)).collect():  # splits of all trees
            found[m][t] = made
        for m, trees in found.items():
            for start in range(0, len(trees), BATCH):
                grown = blank(len(trees[start:start + BATCH]), largest[m][1])
                for t, levels in enumerate(trees[start:start + BATCH]):
                    for level in levels:
                        put(grown, t, *level)
                taken(start, {m: grown})
    moving = [m for m in largest if m not in alone]
    for start in range(0, max((largest[m][0] for m in moving), default=0), batch):
        growing = {m: blank(min(batch, largest[m][0] - start), largest[m][1]) for m in moving if largest[m][0] > start}
        open_ = set(growing)
        for level in range(max(largest[m][1] for m in growing)):
            asked = {m: (*growing[m][:2], growing[m][3].sum(axis=2, dtype=np.int32)) for m in open_ if largest[m][1] > level}
            if not asked:
                break
            part = state.flatMap(sums(level, start, asked)).reduceByKey(added, len(order))
            open_ = {m for m, t, *splits in part.map(best).collect() if put(growing[m], t, *splits)}  # splits: trees of a batch x nodes of the level
        taken(start, growing)
    state.unpersist()
    return out


def _packed(feature, cut, gain, counts, cuts) -> Tree:
    """The nodes that exist, numbered without gaps."""
    there = counts.sum(axis=1) > 0
    there[0] = True
    place = np.cumsum(there) - 1
    kept = np.flatnonzero(there)
    f = feature[kept]
    inner = f >= 0
    threshold = np.full(len(kept), np.inf)
    threshold[inner] = [cuts[j][c] for j, c in zip(f[inner], cut[kept][inner])]
    left = np.full(len(kept), -1)
    left[inner] = place[2 * kept[inner] + 1]
    return Tree(f, threshold, left, np.where(inner, gain[kept], -1.0), counts[kept])


def spark_model(spark: SparkSession, forest: Forest):
    """The forest as Spark ML's own model: a stored one of as many bare trees, its table of nodes replaced."""
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.util import Identifiable

    gateway = spark.sparkContext._gateway
    ml, double = gateway.jvm.org.apache.spark.ml, gateway.jvm.double
    stats = gateway.new_array(double, 2)
    bare = ml.tree.LeafNode(0.0, 0.0, gateway.jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator(stats, 0))
    uid = f"rfc_{Identifiable().uid.rsplit('_', 1)[-1]}"
    trees = gateway.new_array(ml.classification.DecisionTreeClassificationModel, len(forest.trees))
    for k in range(len(forest.trees)):
        trees[k] = ml.classification.DecisionTreeClassificationModel(f"{uid}_{k}", bare, forest.width, 2)
    path = shared_folder(spark)
    RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(uid, trees, forest.width, 2))._set(numTrees=len(forest.trees)).save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    columns: dict[str, list] = {name: [] for name in ("tree", "id", "f", "t", "l", "g", "n0", "n1")}
    for k, t in enumerate(forest.trees):
        n = len(t.feature)
        for name, values in zip(columns, (np.full(n, k), np.arange(n), t.feature, t.threshold, t.left, t.gain, t.counts[:, 0], t.counts[:, 1])):
            columns[name].append(values)
    nodes = spark.createDataFrame(pa.table({name: np.concatenate(values) for name, values in columns.items()}))  # trees x nodes
    inner, c = F.col("f") >= 0, F.col
    w0, w1 = (c(f"n{k}") * F.lit(float(forest.weights[k])) for k in (0, 1))
    nodes = nodes.withColumn("w0", w0).withColumn("w1", w1).withColumn("p", F.try_divide("w1", c("w0") + c("w1")))
    data = F.struct(
        c("id").cast("int").alias("id"), (c("w1") > c("w0")).cast("int").cast("double").alias("prediction"),
        (2 * c("p") * (1 - c("p"))).alias("impurity"), F.array("w0", "w1").alias("impurityStats"), (c("n0") + c("n1")).alias("rawCount"), c("g").alias("gain"),
        c("l").cast("int").alias("leftChild"), F.when(inner, c("l") + 1).otherwise(-1).cast("int").alias("rightChild"),
        F.struct(c("f").cast("int").alias("featureIndex"), F.when(inner, F.array("t")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split"))
    nodes.select(c("tree").cast("int").alias("treeID"), data.cast(schema["nodeData"].dataType).alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def job(params: Mapping[str, Any], span: tuple[int, int] = EVERYTHING) -> Job:
    """A job from grid names; names without counterpart are refused."""
    names = {"n_estimators": "trees", "max_depth": "depth", "min_samples_leaf": "least", "max_features": "features"}
    return Job(span, **{names[k]: v for k, v in params.items()})
