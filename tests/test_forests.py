import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.operators import boosting, forests as R
from test_boosting import jobs_of


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 4)), 2)
    y = ((x[:, 0] > 0.8) ^ (rng.uniform(size=900) < 0.1)).astype(int)
    table = [(k // 3, f"T{k % 3}", [float(v) for v in x[k]], int(y[k])) for k in range(900)]
    return spark.createDataFrame(table, "ordinal int, ticker string, x array<double>, target int").select(
        F.date_add(F.lit("2020-01-01").cast("date"), "ordinal").alias("date"), "ticker", "ordinal", array_to_vector("x").alias("features"), "target").persist()


def equal(a, b):
    return len(a.trees) == len(b.trees) and all(
        np.array_equal(s.feature, t.feature) and np.array_equal(s.threshold, t.threshold) and np.array_equal(s.counts, t.counts) for s, t in zip(a.trees, b.trees))


def test_many_forests_take_the_jobs_of_one(spark, rows):
    many = [R.Job((0, to), 12, depth, least, share) for to in (100, 200, 300) for depth in (2, 4) for least in (5, 20) for share in ("sqrt", "0.75")]
    alone, a = jobs_of(spark, "one forest", lambda: R.fit_many(rows, [R.Job(trees=12, depth=4, least=5)]))
    grown, b = jobs_of(spark, "forests", lambda: R.fit_many(rows, many))
    assert [len(f.trees) for f in grown] == [12] * 24 and b <= a + 2 and a <= 4 + 6
    assert equal(alone[0], next(f for f, j in zip(grown, many) if j == R.Job((0, 300), 12, 4, 5, "sqrt")))


def test_blocks_batches_and_tasks_do_not_change_a_tree(rows):
    jobs = [R.Job((0, 250), 9, 4, 3, "0.5"), R.Job(trees=9, depth=2)]
    whole, cut = R.fit_many(rows, jobs), R.fit_many(rows.repartition(5), jobs, block_rows=70)
    assert equal(whole[0], cut[0]) and equal(whole[1], cut[1])
    assert equal(whole[0].first(4), R.fit_many(rows, [R.Job((0, 250), 4, 4, 3, "0.5")])[0])
    for tree in whole[0].trees:
        leaves = tree.counts[tree.feature < 0].sum(axis=1)
        assert leaves.min() >= 3 and leaves.sum() == tree.counts[0].sum() and (tree.counts >= 0).all()


def test_ranges_of_one_block_take_one_job_for_all_trees(spark, rows):
    jobs = [R.Job((0, to), trees, depth, 5) for to in (100, 300) for trees, depth in ((60, 6), (9, 3))]
    grown, n = jobs_of(spark, "one block", lambda: R.fit_many(rows, jobs))
    assert [len(f.trees) for f in grown] == [60, 9] * 2 and n <= 12
    # A shallower forest alone, and ranges of one block beside ranges of several.
    assert equal(grown[1], R.fit_many(rows, [jobs[1]])[0])
    assert all(equal(a, b) for a, b in zip(grown, R.fit_many(rows, jobs, block_rows=300), strict=True))


def test_trees_see_rows_drawn_with_replacement(rows):
    sizes = [t.counts[0].sum() for t in R.fit_many(rows, [R.Job(trees=40, depth=1)])[0].trees]
    assert np.mean(sizes) == pytest.approx(900, abs=25) and len(set(sizes)) > 20


def test_spark_model_scores_as_the_trees_do(spark, rows):
    from barloom.operators.models import _grown, with_probability

    forest, empty = R.fit_many(rows, [R.Job(trees=7, depth=5, least=4), R.Job((-5, 0), 7)])
    assert empty.trees == [] and empty.rows == 0
    fitted = _grown(spark, forest)
    assert fitted.model.stages[-1].getNumTrees == 7
    own = boosting.score_many(rows, [((0, 300), 0, forest, {0: 3, 1: 7})], ["date", "ticker"]).where("combination = 1")
    both = own.join(with_probability(fitted, rows).select("date", "ticker", "target", F.col("prob_up").alias("p")), ["date", "ticker"])
    assert both.count() == 900 and both.where("abs(p - prob_up) > 1e-12").isEmpty()
    assert both.where("(p > 0.5) = (target = 1)").count() > 780
    values = fitted.model.stages[-1].featureImportances.toArray()
    assert values.argmax() == 0 and values.sum() == pytest.approx(1.0)


def test_walk_forward_trees_are_refitted_together(spark, rows):
    from barloom.operators import models as M
    from barloom.params import ResearchParams

    specs = M.model_specs(ResearchParams(models={n: {"enabled": False} for n in ("majority", "logreg_none", "logreg_l1", "logreg_l2")}))
    frozen = [(specs["random_forest"], {"n_estimators": 4, "max_depth": 3}), (specs["gbt[mllib]"], {"n_estimators": 4, "max_depth": 2})]
    folds = [{"fold": k, "train_to": 99 + 50 * k, "test_from": 100 + 50 * k, "test_to": 150 + 50 * k} for k in range(4)]
    panel = rows.withColumn("fwd_ret", F.lit(0.01))
    got, jobs = jobs_of(spark, "walk", lambda: M.walk_forward_predictions(frozen, panel, folds))
    assert got.count() == 2 * 600 and jobs <= 4 * 2 + 3 + 16
    for spec, params in frozen:
        alone = M.predictions(spec, M.fit(spec, params, panel.where("ordinal < 149")), panel.where("ordinal >= 150 and ordinal < 200"), "x")
        both = got.where((F.col("model") == spec.name) & (F.col("fold") == 1)).join(alone.select("date", "ticker", F.col("prob_up").alias("p")), ["date", "ticker"])
        assert both.count() == 150 and both.where("abs(p - prob_up) > 1e-12").isEmpty()
