"""Many boosted tree ensembles in one pass over the rows.

All ensembles of a search (grid points, folds and the final fits) grow together. Features are cut once per training
range at quantiles of its own rows. Rows lie in blocks of bounded size; a task holds one block of one training range and a few
of the ensembles on it, adds up count, sum and square sum of the residuals per node, feature and bin, and where a
range has several blocks these sums are added by key. The best split of a node is found where its sums are; the driver gets splits only.
Ensembles on ranges of several blocks take one Spark job a tree level, all of them together, so the number of jobs is trees times
depth and not that times folds times grid. A range of one block needs nothing from other tasks: its ensembles grow to the end in the
tasks that hold it, all in one job.

What is fitted is what Spark ML's gradient boosting fits: loss 2 log(1 + exp(-2 y F)) with labels -1 and 1, regression trees
by variance on its negative gradient, the first tree on the labels with weight 1, the others with weight `rate`; a row is in a
tree with chance `rows`, a node sees a share `columns` of the features. Both are drawn by hashes of the row's date and
ticker or of the node, and residuals are rounded to 28 binary places, so that sums (of up to 8 million rows) are exact
and results do not depend on blocks, tasks or their order. The first n trees are the ensemble of n.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.logistic import EVERYTHING
from barloom.sources.session import shared_folder

#: Rows of a block at most, on average.
BLOCK_ROWS = 50_000
#: Trees after which the margins are written, so that the lineage stays short.
KEPT_TREES = 25


@dataclass(frozen=True)
class Job:
    """One ensemble: the ordinals it is trained on (from, to) and its parameters, with Spark ML's defaults."""

    span: tuple[int, int] = EVERYTHING
    trees: int = 20
    depth: int = 5
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0


@dataclass
class Tree:
    """Nodes in heap order: the children of k are 2k + 1 and 2k + 2; `feature` is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray         # bin, then threshold: larger values go right
    threshold: np.ndarray
    gain: np.ndarray
    stats: np.ndarray       # rows, sum and square sum of residuals

    @property
    def value(self) -> np.ndarray:
        return self.stats[:, 1] / np.maximum(self.stats[:, 0], 1.0)


@dataclass
class Ensemble:
    """Trees of one job; none where only one class was seen."""

    trees: list[Tree]
    rate: float
    prior: float
    rows: int
    width: int

    def first(self, n: int) -> Ensemble:
        return Ensemble(self.trees[:n], self.rate, self.prior, self.rows, self.width)

    def table(self) -> tuple | None:
        """What `score_many` scores with: nodes of all trees one after the other."""
        if not self.trees:
            return None
        sizes = np.array([len(t.feature) for t in self.trees])
        starts = np.cumsum(sizes) - sizes
        left = np.concatenate([2 * np.arange(n) + 1 + s for n, s in zip(sizes, starts)])
        value = np.concatenate([t.value * (self.rate if k else 1.0) for k, t in enumerate(self.trees)])
        return (starts, max(int(n).bit_length() for n in sizes) - 1, np.concatenate([t.feature for t in self.trees]),
                np.concatenate([t.threshold for t in self.trees]), left, value, "odds")


def placed_rows(rows: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """Rows once per span that holds them: (span, x, y, key); spans are numbered."""
    o = F.col("ordinal").cast("long") if "ordinal" in rows.columns else F.lit(0).cast("long")
    inside = F.filter(F.array(*(F.when((o >= a) & (o < b), k) for k, (a, b) in enumerate(spans))), lambda s: s.isNotNull())
    return rows.select(F.explode(inside).alias("span"), vector_to_array("features").alias("x"),
                       F.col("target").cast("double").alias("y"), F.xxhash64("date", "ticker").alias("key"))


def span_facts(placed: DataFrame, width: int, max_bins: int) -> dict[int, tuple[int, int, list[np.ndarray]]]:
    """Per span: rows, positive rows and the cut points of each feature (at most max_bins - 1)."""
    shares = F.lit([k / max_bins for k in range(1, max_bins)])  # one literal: each takes some calls into the JVM for every share
    cuts = [F.percentile_approx(F.get("x", F.lit(j)), shares, 10000).alias(f"c{j}") for j in range(width)]
    found = placed.groupBy("span").agg(F.count("*").alias("n"), F.sum("y").alias("ups"), *cuts).collect()  # spans x features x bins
    return {r["span"]: (r["n"], int(r["ups"]), [np.unique(np.array(r[f"c{j}"], float)) for j in range(width)]) for r in found}


def range_facts(rows: DataFrame, spans: Iterable[tuple[int, int]], max_bins: int) -> tuple[int, dict[tuple[int, int], tuple]]:
    """(features, `span_facts` by range): what forests and boosting both start from."""
    spans = list(dict.fromkeys(spans))
    head = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    width = head["n"] if head else 0
    found = span_facts(placed_rows(rows, spans), width, max_bins)
    return width, {span: found[k] for k, span in enumerate(spans) if k in found}


def binned_blocks(placed: DataFrame, cuts: Mapping[int, list[np.ndarray]], blocks: Mapping[int, int]) -> DataFrame:
    """(span, block, bins, y, key): one row a block, features as bin numbers."""
    def run(key, table):
        own = cuts[key[0].as_py()]
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(own)], axis=1).astype(np.uint16)
        y, hashed = table.column("y").to_numpy(), table.column("key").to_numpy()
        return pa.table({"span": [key[0].as_py()], "block": [key[1].as_py()], "bins": [bins.tobytes()], "y": [y.tobytes()], "key": [hashed.tobytes()]},
                        schema=pa.schema([("span", pa.int32()), ("block", pa.int32()), ("bins", pa.binary()), ("y", pa.binary()), ("key", pa.binary())]))

    many = F.element_at(F.create_map(*(F.lit(v) for pair in blocks.items() for v in pair)), F.col("span"))
    cut = placed.where(F.col("span").isin(list(blocks))).withColumn("block", F.pmod("key", many).cast("int"))
    return cut.groupBy("span", "block").applyInArrow(run, "span int, block int, bins binary, y binary, key binary")


def hashing(seed: int):
    """A function for tasks: hash of each value with some numbers, uniform in [0, 1)."""
    def mixed(values, *keys):
        h = values.astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in (seed, *keys):
                h = h + np.uint64((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(31))
        return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return mixed


def walking():
    """A function for tasks: heap node of each row after some levels, from the root or from the nodes of a level above."""
    def places(bins, feature, cut, levels, node=None):
        node, at = np.zeros(len(bins), np.int64) if node is None else node, np.arange(len(bins))
        for _ in range(levels):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[at, np.maximum(f, 0)] > cut[node]), node)
        return node
    return places


def splitting():
    """Functions for tasks and the driver: (feature, cut, gain, stats) of a tree in heap order, and the splits of a level put into it."""
    def blank(depth):
        size = (2 << depth) - 1
        return np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros((size, 3))

    def split(features, cuts, gains, stats, found):
        """Whether there are any splits."""
        any_ = False
        for node, feature, cut, gain, whole, left in found:
            stats[node] = whole
            if feature >= 0:
                any_ = True
                features[node], cuts[node], gains[node] = feature, cut, gain
                stats[2 * node + 1], stats[2 * node + 2] = left, whole - left
        return any_

    return blank, split


def _tasks(seed: int, width: int, cuts: Mapping[int, list[np.ndarray]]):
    """The functions that run in tasks, which hold all they need: executors have no copy of this package."""
    counts = {s: np.array([len(c) for c in own]) for s, own in cuts.items()}
    most = {s: int(c.max(initial=0)) + 1 for s, c in counts.items()}
    mixed, places, (blank, split) = hashing(seed), walking(), splitting()

    def unpacked(record):
        span, block, numbers, bins, y, key, margins = record
        y = np.frombuffer(y)
        return np.frombuffer(bins, np.uint16).reshape(len(y), width), np.where(y == 1, 1.0, -1.0), np.frombuffer(key, np.int64), margins

    def grown(trees):
        """A state with the finished trees added to the margins; `trees` has (feature, cut, value, depth) by ensemble."""
        def run(record):
            span, block, numbers, raw, y, key, margins = record
            bins, _, _, margins = unpacked(record)
            margins = margins.copy()
            for k, m in enumerate(numbers):
                if m in trees:
                    feature, cut, value, depth = trees[m]
                    margins[k] += value[places(bins, feature, cut, depth)]
            return span, block, numbers, raw, y, key, margins
        return run

    def drawn(number, share, y, key, margin):
        """Rows that the tree sees (None: all), their residuals and squares."""
        at = None if share >= 1.0 else np.flatnonzero(mixed(key, 1, number) < share)
        y, margin = (y, margin) if at is None else (y[at], margin[at])
        residual = y if number == 0 else 4.0 * y / (1.0 + np.exp(np.clip(2.0 * y * margin, -700, 700)))
        r = np.round(residual * (1 << 28)) / (1 << 28)
        return at, r, np.round(r * r * (1 << 28)) / (1 << 28)

    def histogram(level, size, node, columns, *values):
        """Counts and sums of values by feature, node and bin of rows in `node` of the level (below zero: in none); `columns` has the bins by feature."""
        if level and node.min(initial=0) < 0:
            used = np.flatnonzero(node >= 0)
            node, columns, values = node[used], columns[:, used], [v[used] for v in values]
        at, total = node * size, np.empty((1 + len(values), width, (1 << level) * size))
        for j in range(width):
            place = at + columns[j]
            total[0, j] = np.bincount(place, minlength=total.shape[2])
            for k, v in enumerate(values):
                total[1 + k, j] = np.bincount(place, v, total.shape[2])
        return total

    def halved(level, size, node, columns, r, above, feature):
        """`histogram` where the level above is known: the smaller child of a node is added up, the other is the rest. Sums are exact, so this is too."""
        parents = 1 << (level - 1)
        sizes = np.bincount(node[node >= 0], minlength=2 * parents).reshape(parents, 2)
        small = (sizes[:, 1] < sizes[:, 0]).astype(np.int64)
        inner = feature[parents - 1:2 * parents - 1] >= 0
        used = np.flatnonzero((node >= 0) & (node - 2 * (node >> 1) == small[node >> 1]))
        part = histogram(level - 1, size, node[used] >> 1, columns[:, used], r[used]).reshape(2, width, parents, size)
        total, every = np.zeros((2, width, parents, 2, size)), np.flatnonzero(inner)
        total[:, :, every, small[every]] = part[:, :, every]
        total[:, :, every, 1 - small[every]] = above.reshape(2, width, parents, size)[:, :, every] - part[:, :, every]
        return total.reshape(2, width, 2 * parents * size)

    def filled(found):
        """Splits found without square sums, as `split` takes them."""
        return [(node, *rest, np.append(whole, 0.0), None if left is None else np.append(left, 0.0)) for node, *rest, whole, left in found]

    def sums(level, number, trees):
        """((ensemble), (span, sums by node, feature, bin)) of one block; `trees` has (feature, cut, share of rows) by ensemble."""
        def run(record):
            span, numbers = record[0], record[2]
            bins, y, key, margins = unpacked(record)
            for k, m in enumerate(numbers):
                if m not in trees:
                    continue
                feature, cut, share, _ = trees[m]
                at, r, square = drawn(number, share, y, key, margins[k])
                b = bins if at is None else bins[at]
                node = places(b, feature, cut, level) - ((1 << level) - 1)
                yield m, (span, histogram(level, most[span], node, b.T, r, square))
        return run

    def whole(wanted):
        """(ensemble, [(feature, cut, gain, stats) of each tree]) of a block that is a training range; `wanted` has (trees, depth, rate, rows, columns)."""
        def run(record):
            span, numbers = record[0], record[2]
            bins, y, key, _ = unpacked(record)
            columns = np.ascontiguousarray(bins.T)
            for m in numbers:
                trees, depth, rate, share, seen = wanted[m]
                margin, made = np.zeros(len(y)), []
                for number in range(trees):
                    tree = blank(depth)
                    at, r, square = drawn(number, share, y, key, margin)
                    b, c = (bins, columns) if at is None else (bins[at], columns[:, at])
                    node = np.zeros(len(b), np.int64)
                    for level in range(depth):
                        local = node - ((1 << level) - 1)
                        total = halved(level, most[span], local, c, r, total, tree[0]) if level else histogram(0, most[span], local, c, r)
                        _, found = best(level, number, {m: (None, None, share, seen)})((m, (span, total)))
                        if not split(*tree, filled(found)):
                            break
                        node = places(b, tree[0], tree[1], 1, node)
                    # No split asks for square sums: those of leaves are added up once and handed up.
                    squares = np.bincount(node, square, len(tree[0]))
                    for k in np.flatnonzero(tree[0] >= 0)[::-1]:
                        squares[k] = squares[2 * k + 1] + squares[2 * k + 2]
                    tree[3][:, 2] = squares
                    made.append(tree)
                    node = node if at is None else places(bins, tree[0], tree[1], depth)
                    margin += (tree[3][:, 1] / np.maximum(tree[3][:, 0], 1.0) * (rate if number else 1.0))[node]
                yield m, made
        return run

    def added(a, b):
        return a[0], a[1] + b[1]

    def best(level, number, trees):
        """(ensemble, [node, feature or -1, bin, gain, sums of the node, sums of its left child]) of every node with rows."""
        def run(item):
            m, (span, total) = item
            size, share, found = most[span], trees[m][3], []
            seen = max(1, int(np.ceil(share * width)))
            for local in range(1 << level):
                part = total[:, :, local * size:(local + 1) * size]
                whole = part[:, 0].sum(axis=1)
                if whole[0] == 0:
                    continue
                node = (1 << level) - 1 + local
                left = np.cumsum(part, axis=2)[:, :, :-1]
                right = whole[:, None, None] - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]) / whole[0]
                ok = (left[0] > 0) & (right[0] > 0) & (np.arange(size - 1)[None, :] < counts[span][:, None])
                if seen < width:
                    chance = mixed(np.arange(width), 2, number, node)
                    ok &= (np.argsort(np.argsort(chance)) < seen)[:, None]
                gain = np.where(ok, gain, -1.0)
                at = int(np.argmax(gain)) if gain.size else -1
                f, c = divmod(at, max(size - 1, 1))
                if at < 0 or gain[f, c] <= 1e-15:
                    found.append((node, -1, 0, 0.0, whole, None))
                else:
                    found.append((node, f, c, float(gain[f, c]), whole, left[:, f, c]))
            return m, found
        return run

    return grown, sums, added, best, whole


def fit_many(rows: DataFrame, jobs: list[Job], seed: int = 42, max_bins: int = 128, block_rows: int = BLOCK_ROWS, facts: tuple | None = None) -> list[Ensemble]:
    """Fit all jobs on rows with date, ticker, features, target and (if spans are used) ordinal; `facts` are known `range_facts` of them."""
    spark = rows.sparkSession
    context = spark.sparkContext
    spans = list(dict.fromkeys(j.span for j in jobs))
    placed = placed_rows(rows, spans)
    width, known = facts or range_facts(rows, spans, max_bins)
    facts = {k: known[span] for k, span in enumerate(spans) if span in known}
    out = []
    for job in jobs:
        n, ups, _ = facts.get(spans.index(job.span), (0, 0, []))
        out.append(Ensemble([], job.rate, ups / n if n else 0.0, n, width))
    moving = [m for m, e in enumerate(out) if 0 < e.prior < 1]
    if not moving:
        return out
    used = {spans.index(jobs[m].span) for m in moving}
    blocks = {s: -(-facts[s][0] // block_rows) for s in sorted(used)}
    cuts = {s: facts[s][2] for s in used}
    # Ensembles of one span share its binned rows; they are dealt out so that there is about one task a core, three of those that grow in one job.
    dealt: dict[int, list[list[int]]] = {}
    for s in blocks:
        own = [m for m in moving if jobs[m].span == spans[s]]
        tasks = max(context.defaultParallelism, 1) * (1 if blocks[s] > 1 else 3)
        size = max(1, -(-len(moving) * sum(blocks.values()) // (len(blocks) * tasks)))
        dealt[s] = [own[k:k + size] for k in range(0, len(own), size)]
    order = {key: k for k, key in enumerate((s, b, g) for s in sorted(blocks, key=lambda s: -facts[s][0]) for b in range(blocks[s]) for g in range(len(dealt[s])))}

    def spread(r):
        n = len(r["y"]) // 8
        for g, numbers in enumerate(dealt[r["span"]]):
            yield order[r["span"], r["block"], g], (r["span"], r["block"], numbers, bytes(r["bins"]), bytes(r["y"]), bytes(r["key"]), np.zeros((len(numbers), n)))

    grown, sums, added, best, whole = _tasks(seed, width, cuts)
    state = binned_blocks(placed, cuts, blocks).rdd.flatMap(spread).partitionBy(len(order), lambda k: k).values().persist(StorageLevel.MEMORY_AND_DISK)
    at = {m: spans.index(jobs[m].span) for m in moving}
    wanted = {m: (j.trees, j.depth, j.rate, j.rows, j.columns) for m in moving if blocks[at[m]] == 1 for j in [jobs[m]]}
    if wanted:
        for m, made in state.filter(lambda record: blocks[record[0]] == 1).flatMap(whole(wanted)).collect():  # trees
            out[m].trees += [_tree(t, cuts[at[m]]) for t in made]
    moving = [m for m in moving if m not in wanted]
    if moving and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    blank, split = splitting()
    for number in range(max((jobs[m].trees for m in moving), default=0)):
        active = [m for m in moving if jobs[m].trees > number]
        trees = {m: blank(jobs[m].depth) for m in active}
        previous = state
        if number:
            finished = {m: (t.feature, t.cut, t.value * (1.0 if number == 1 else jobs[m].rate), jobs[m].depth)
                        for m in active for t in out[m].trees[-1:]}
            state = previous.map(grown(finished)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % KEPT_TREES == 0:
                state.checkpoint()
        open_ = set(active)
        for level in range(max(jobs[m].depth for m in active)):
            asked = {m: (*trees[m][:2], jobs[m].rows, jobs[m].columns) for m in open_ if jobs[m].depth > level}
            if not asked:
                break
            part = state.flatMap(sums(level, number, asked)).reduceByKey(added, len(order))
            for m, found in part.map(best(level, number, asked)).collect():  # splits: ensembles x nodes of the level
                if not split(*trees[m], found):
                    open_.discard(m)
        if number:
            previous.unpersist()
        for m in active:
            out[m].trees.append(_tree(trees[m], cuts[at[m]]))
    state.unpersist()
    return out


def _tree(grown: tuple[np.ndarray, ...], cuts: list[np.ndarray]) -> Tree:
    feature, cut, gain, stats = grown
    threshold = np.full(len(feature), np.inf)
    for k in np.flatnonzero(feature >= 0):
        threshold[k] = cuts[feature[k]][cut[k]]
    return Tree(feature, cut, threshold, gain, stats)


def score_many(rows: DataFrame, models: Iterable[tuple[tuple[int, int], int, Any, Mapping[int, int]]], keep: list[str]) -> DataFrame:
    """(keep, fold, combination, prob_up) of the rows of each ordinal range under its ensembles, in one pass over the rows.

    `models` has (range, fold, ensemble or forest, {combination: its first trees}).
    """
    tables = [(span, fold, e.table(), e.prior, dict(sizes)) for span, fold, e, sizes in models]
    lowest, highest = min(t[0][0] for t in tables), max(t[0][1] for t in tables)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields]
    read = rows.where((F.col("ordinal") >= lowest) & (F.col("ordinal") < highest)).select(
        *keep, F.col("ordinal").cast("long").alias("_o"), vector_to_array("features").alias("_x"))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(tables)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            o = batch.column(len(keep)).to_numpy()
            x = batch.column(len(keep) + 1).flatten().to_numpy(zero_copy_only=False).reshape(len(o), -1)
            for (a, b), fold, table, prior, sizes in shared.value:
                own = np.flatnonzero((o >= a) & (o < b))
                if not len(own):
                    continue
                margin, done, z = np.zeros(len(own)), 0, x[own]
                at, taken = np.arange(len(own)), batch.take(pa.array(own))
                for c, n in sorted(sizes.items(), key=lambda s: s[1]):
                    if table is None:
                        p = np.full(len(own), prior)
                    else:
                        starts, depth, feature, threshold, left, value, kind = table
                        for start in starts[done:n]:
                            node = np.full(len(own), start)
                            for _ in range(depth):
                                f = feature[node]
                                node = np.where(f >= 0, left[node] + ~(z[at, np.maximum(f, 0)] <= threshold[node]), node)
                            margin += value[node]
                        done = n
                        p = margin / n if kind == "mean" else 1.0 / (1.0 + np.exp(np.clip(-2.0 * margin, -700, 700)))
                    columns = [taken.column(k) for k in range(len(keep))] + [
                        pa.array(np.full(len(own), fold, np.int32)), pa.array(np.full(len(own), c, np.int32)), pa.array(p)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fold", "combination", "prob_up"])

    return read.repartition(context.defaultParallelism).mapInArrow(run, ", ".join([*kept, "fold int", "combination int", "prob_up double"]))


def spark_model(spark: SparkSession, ensemble: Ensemble):
    """The ensemble as Spark ML's own model, to be stored and applied like any other."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.ml.util import Identifiable

    gateway = spark.sparkContext._gateway
    ml, tree_ = gateway.jvm.org.apache.spark.ml, gateway.jvm.org.apache.spark.ml.tree
    calculator = gateway.jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def doubles(values):
        made = gateway.new_array(gateway.jvm.double, len(values))
        for k, v in enumerate(values):
            made[k] = float(v)
        return made

    def node(t: Tree, k: int):
        n, s, ss = map(float, t.stats[k])
        impurity, stats = max(ss / n - (s / n) ** 2, 0.0), calculator(doubles((n, s, ss)), int(n))
        if t.feature[k] < 0:
            return tree_.LeafNode(s / n, impurity, stats)
        split = tree_.ContinuousSplit(int(t.feature[k]), float(t.threshold[k]))
        return tree_.InternalNode(s / n, impurity, float(t.gain[k]), node(t, 2 * k + 1), node(t, 2 * k + 2), split, stats)

    uid = f"gbtc_{Identifiable().uid.rsplit('_', 1)[-1]}"
    trees = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(ensemble.trees))
    for k, t in enumerate(ensemble.trees):
        trees[k] = ml.regression.DecisionTreeRegressionModel(f"{uid}_{k}", node(t, 0), ensemble.width)
    weights = doubles([1.0] + [ensemble.rate] * (len(ensemble.trees) - 1))
    return GBTClassificationModel(ml.classification.GBTClassificationModel(uid, trees, weights, ensemble.width, 2))


def job(params: Mapping[str, Any], span: tuple[int, int] = EVERYTHING) -> Job:
    """A job from grid names; names without counterpart are refused."""
    names = {"n_estimators": "trees", "max_depth": "depth", "learning_rate": "rate", "subsample": "rows", "colsample_bytree": "columns"}
    return Job(span, **{names[k]: v for k, v in params.items()})
