import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.operators import boosting as B


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 4)), 2)
    y = ((x[:, 0] > 0.3) ^ (rng.uniform(size=900) < 0.2)).astype(int)
    table = [(k // 3, f"T{k % 3}", [float(v) for v in x[k]], int(y[k])) for k in range(900)]
    return spark.createDataFrame(table, "ordinal int, ticker string, x array<double>, target int").select(
        F.date_add(F.lit("2020-01-01").cast("date"), "ordinal").alias("date"), "ticker", "ordinal", array_to_vector("x").alias("features"), "target").persist()


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("other", "other")
    return out, len(ids)


def test_many_ensembles_take_the_jobs_of_one(spark, rows):
    one = [B.Job(trees=6, depth=3)]
    many = [B.Job((0, to), 6, depth, rate) for to in (100, 200, 300) for depth in (1, 2, 3) for rate in (0.1, 0.3)]
    alone, a = jobs_of(spark, "alone", lambda: B.fit_many(rows, one))
    grown, b = jobs_of(spark, "many", lambda: B.fit_many(rows, many))
    assert [len(e.trees) for e in grown] == [6] * 18 and b <= a + 2 and a <= 6 * 3 + 6
    assert all((s.feature == t.feature).all() and (s.stats == t.stats).all() for s, t in zip(alone[0].trees, grown[-2].trees, strict=True))


def test_blocks_and_tasks_do_not_change_a_bit(rows):
    jobs = [B.Job((0, 250), 8, 3, 0.2, 0.7, 0.5), B.Job(trees=8, depth=2)]
    whole, cut = B.fit_many(rows, jobs), B.fit_many(rows.repartition(5), jobs, block_rows=70)
    for a, b in zip(whole, cut, strict=True):
        for s, t in zip(a.trees, b.trees, strict=True):
            assert (s.feature == t.feature).all() and (s.threshold == t.threshold).all() and (s.stats == t.stats).all()


def test_ranges_of_one_block_take_one_job_for_all_trees(spark, rows):
    jobs = [B.Job((0, to), trees, depth, 0.3, share, 0.5) for to in (100, 300) for trees, depth, share in ((30, 2, 1.0), (20, 4, 0.6))]
    grown, n = jobs_of(spark, "one block", lambda: B.fit_many(rows, jobs))
    assert [len(e.trees) for e in grown] == [30, 20] * 2 and n <= 8
    # Ranges of one block beside ranges of several: both ways to grow in one call.
    mixed = B.fit_many(rows, jobs, block_rows=300)
    for a, b in zip(grown, mixed, strict=True):
        assert all((s.feature == t.feature).all() and (s.threshold == t.threshold).all() and (s.stats == t.stats).all() for s, t in zip(a.trees, b.trees, strict=True))


def test_splits_are_the_best_by_variance(rows):
    tree = B.fit_many(rows, [B.Job(trees=1, depth=2)], max_bins=2000)[0].trees[0]
    found = rows.collect()
    x, y = np.array([r.features.toArray() for r in found]), np.array([2.0 * r.target - 1 for r in found])

    def best(own):
        gains = {}
        for j in range(4):
            for v in np.unique(x[own, j])[:-1]:
                left = own & (x[:, j] <= v)
                right = own & ~left
                gains[j, v] = (y[own].var() * own.sum() - y[left].var() * left.sum() - y[right].var() * right.sum()) / own.sum()
        return gains

    for node, own in ((0, np.ones(900, bool)), (1, x[:, tree.feature[0]] <= tree.threshold[0]), (2, x[:, tree.feature[0]] > tree.threshold[0])):
        gains = best(own)
        assert tree.gain[node] == pytest.approx(max(gains.values()), abs=1e-9)
        assert gains[tree.feature[node], tree.threshold[node]] == pytest.approx(max(gains.values()), abs=1e-9)
        assert tree.value[node] == pytest.approx(y[own].mean())


def test_spark_model_scores_as_the_trees_do(spark, rows):
    from barloom.operators.models import _grown, with_probability

    ensemble, empty = B.fit_many(rows, [B.Job(trees=7, depth=3), B.Job((-5, 0), 7)])
    assert empty.trees == [] and empty.rows == 0
    own = B.score_many(rows, [((0, 300), 0, ensemble, {0: 3, 1: 7})], ["date", "ticker"]).where("combination = 1")
    both = own.join(with_probability(_grown(spark, ensemble), rows).select("date", "ticker", F.col("prob_up").alias("p")), ["date", "ticker"])
    assert both.count() == 900 and both.where("abs(p - prob_up) > 1e-12").isEmpty()
