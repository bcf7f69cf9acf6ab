"""Centroid clustering: assignment through a vantage-point tree, exact integer arithmetic.

Vectors become integers once and are written to the shared folder. In every round the driver builds a vantage-point tree over the
centroids (as many as the parameter says, so its size is bounded) and broadcasts it. Each vector is searched best-first: the open
node with the least lower bound is opened next, and the search ends when that bound lies beyond the best distance found; one on the
radius is still opened, since a tie may have the smaller number. A whole Arrow batch is searched in lockstep, each vector along its own
path. Bounds are floating-point numbers with a margin below any true distance; distances that decide are integers.

Tasks return one record per centroid, its count and componentwise sums, so a centroid with a third of all vectors is no hot
key, and the driver gets centroids x (components + 1) numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, map_batches, stored, table

#: Components up to this keep squared distances of 64 components within 62 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class ClusterRules:
    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: int = 3
    leaf: int = 2        # centroids of a leaf
    batch: int = 4096    # vectors searched in lockstep


class VantageTree:
    """Nodes as arrays. An inner node has a centroid, its vantage point, and two children with the least and largest
    distance of their members from it; a leaf has up to `leaf` centroids."""

    def __init__(self, points: np.ndarray, leaf: int = 2):
        self.points = points
        self.members: list[list[int]] = []   # of leaves
        self.vantage: list[int] = []         # -1 in leaves
        self.children: list[list[tuple[int, float, float]]] = []
        self._build(list(range(len(points))), max(1, leaf))

    def _build(self, members: list[int], leaf: int) -> int:
        at = len(self.vantage)
        self.vantage.append(-1)
        self.members.append(members)
        self.children.append([])
        if len(members) > leaf:
            # The member farthest from the first is a good vantage point: it parts the others well.
            spread = np.array(self._squares(self.points[members], members[0]))
            vantage = members[int(spread.argmax())]
            rest = [m for m in members if m != vantage]
            far = np.sqrt(self._squares(self.points[rest], vantage).astype(np.float64))
            order = np.argsort(far, kind="stable")
            half = (len(rest) + 1) // 2
            self.vantage[at], self.members[at] = vantage, []
            for part in (order[:half], order[half:]):
                if len(part):
                    child = self._build([rest[k] for k in part], leaf)
                    self.children[at].append((child, float(far[part].min()), float(far[part].max())))
        return at

    def _squares(self, rows: np.ndarray, point: int) -> np.ndarray:
        apart = rows - self.points[point]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest point of each row; of equally near ones the smaller number."""
        n = len(rows)
        bound = np.full((n, len(self.vantage)), np.inf)
        bound[:, 0] = 0.0
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points))

        def meet(own: np.ndarray, point: int) -> np.ndarray:
            square = self._squares(rows[own], point)
            better = (square < best[own]) | ((square == best[own]) & (point < who[own]))
            best[own[better]], who[own[better]] = square[better], point
            return square

        active = np.arange(n)
        while len(active):
            node = bound[active].argmin(axis=1)
            least = bound[active, node]
            goes = (least <= np.sqrt(best[active].astype(np.float64))) & np.isfinite(least)
            active, node, least = active[goes], node[goes], least[goes]
            bound[active, node] = np.inf
            for k in np.unique(node).tolist():
                own, above = active[node == k], least[node == k]
                for point in self.members[k]:
                    meet(own, point)
                if self.vantage[k] >= 0:
                    far = np.sqrt(meet(own, self.vantage[k]).astype(np.float64))
                    for child, lo, hi in self.children[k]:
                        gap = np.maximum(lo - far, far - hi) - 1e-9 * (far + hi)
                        bound[own, child] = np.maximum(above, gap)
        return who, best


def quantised(vectors: DataFrame, rules: ClusterRules = ClusterRules(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors with the right number of components, all known and finite, as integers floor(scale * component)."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    sound = (F.size(e) == rules.components) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform(e, lambda x: F.floor(x * float(rules.scale)))
    fits = F.forall(e, lambda x: F.abs(x) < LARGEST / rules.scale)
    checked = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // rules.scale}: distances would not fit 64 bits")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(f"`{vec_id}`").alias("vec_id"), checked.alias("x"))


def first_centroids(kept: DataFrame, rules: ClusterRules) -> list[list[int]]:
    """The vectors with the smallest digests of seed and vec_id; of rows alike in it the smaller vector first; null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(rules.clusters)
    return [list(r["x"]) for r in first.collect()]  # as many rows as clusters


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _assigned(kept: DataFrame, tree: VantageTree, rules: ClusterRules) -> DataFrame:
    """(vec_id, cluster, distance) of every kept vector."""
    shared = kept.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rules.batch):
                part = whole.slice(k, rules.batch)
                who, far = shared.value.nearest(_matrix(part.column(1), rules.components))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(who.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return map_batches(kept, run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def moved(kept: DataFrame, centroids: list[list[int]], rules: ClusterRules) -> list[list[int]]:
    """The centroids after one round: exact floors of the means; a centroid without vectors stays."""
    shared = kept.sparkSession.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64), rules.leaf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        count = np.zeros(len(tree.points), np.int64)
        total = np.zeros(tree.points.shape, np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, rules.batch):
                rows = _matrix(whole.column(0).slice(k, rules.batch), rules.components)
                who, _ = tree.nearest(rows)
                count += np.bincount(who, minlength=len(count))
                np.add.at(total, who, rows)
        some = np.flatnonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * rules.components), pa.array(total[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), sums], names=["cluster", "n", "sums"])

    parts = map_batches(kept.select("x"), run, "cluster int, n bigint, sums array<bigint>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(exact("n").alias("n"), exact("part").alias("total"))
    out = [list(c) for c in centroids]
    for r in sums.collect():  # clusters x components numbers
        out[r["cluster"]][r["at"]] = int(r["total"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, rules: ClusterRules = ClusterRules(), vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; the centroids).

    Vectors of another length, or with a missing or infinite component, are left out. Of vectors alike in vec_id the smaller one comes
    first in the choice of centroids; a null vec_id is chosen last and returned as null. Repeated rows count and are returned one by
    one. With fewer vectors than clusters there are fewer centroids; no vectors give an empty result. Equal centroids: the smaller number gets
    the vectors. A component beyond 131,071 in size is an error, since its distances exceed 64 bits. Other columns are not read.
    """
    kept = stored(quantised(vectors, rules, vec_id, embedding))
    centroids = first_centroids(kept, rules)
    empty = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids:
        return kept.sparkSession.createDataFrame([], empty), []
    for _ in range(rules.rounds):
        now = moved(kept, centroids, rules)
        if now == centroids:
            break  # further rounds would change nothing
        centroids = now
    assigned = stored(_assigned(kept, VantageTree(np.array(centroids, np.int64), rules.leaf), rules))
    inertia = [(r["cluster"], r["n"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()]  # a row per cluster
    whole = sum(n for _, n in inertia)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    facts = kept.sparkSession.createDataFrame([(c, n, whole, digest(c)) for c, n in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def with_clusters(vectors: DataFrame, centroids: list[list[int]], rules: ClusterRules = ClusterRules(), embedding: str = "embedding") -> DataFrame:
    """All rows and columns of any vectors, with the nearest of given centroids and the squared distance; null for unsound ones."""
    row, cluster_, distance = fresh(vectors, "row_id", "cluster", "distance")
    numbered = vectors.withColumn(row, F.monotonically_increasing_id())
    found = _assigned(quantised(numbered, rules, row, embedding), VantageTree(np.array(centroids, np.int64), rules.leaf), rules)
    return numbered.join(found.select(F.col("vec_id").alias(row), F.col("cluster").alias(cluster_), F.col("distance").alias(distance)), row, "left").drop(row)


def op12_centroids(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def sql(rules: ClusterRules = ClusterRules()) -> str:
    """All rounds spelled out: every vector against every centroid, for small tables."""
    def nearest(k: int) -> str:
        return f"""a{k} as materialized (select rid, cluster, distance from (
  select v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x))::bigint as distance,
         row_number() over (partition by v.rid order by sum((v.x - c.x) * (v.x - c.x)), c.cluster) as r
  from v join c{k} c on v.j = c.j group by v.rid, c.cluster) where r = 1)"""

    def next_(k: int) -> str:
        return f"""c{k + 1} as materialized (select c.cluster, c.j, coalesce(m.x, c.x) as x from c{k} c left join (
  select a.cluster, v.j, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*))::hugeint // count(*) as x
  from a{k} a join v on a.rid = v.rid group by a.cluster, v.j) m on c.cluster = m.cluster and c.j = m.j)"""

    steps = ",\n".join(f"{nearest(k)},\n{next_(k)}" for k in range(rules.rounds))
    n, last = rules.components, rules.rounds
    return f"""
with e as materialized (select row_number() over (order by vec_id, embedding) as rid, vec_id, embedding from embeddings
  where len(embedding) = {n} and len([y for y in embedding if y is not null and isfinite(y::double)]) = {n}),
v as materialized (select rid, vec_id, u.j, floor({rules.scale}::double * embedding[u.j]::double)::hugeint as x from e, range(1, {n + 1}) u(j)),
s as materialized (select rid, row_number() over (order by sha256('{rules.seed}:' || vec_id)) - 1 as cluster from e qualify cluster < {rules.clusters}),
c0 as materialized (select s.cluster, v.j, v.x from s join v on s.rid = v.rid),
{steps},
{nearest(last)},
h as (select cluster, sha256(string_agg(x::varchar, ',' order by j)) as centroid_sha256 from c{last} group by cluster)
select e.vec_id, a.cluster::int as cluster, a.distance, sum(a.distance) over (partition by a.cluster)::bigint as cluster_inertia,
       sum(a.distance) over ()::bigint as inertia, h.centroid_sha256
from a{last} a join e on a.rid = e.rid join h on a.cluster = h.cluster
"""
