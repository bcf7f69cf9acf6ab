"""Logistic models fitted side by side, against Spark ML and their first-order conditions."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.operators import diagnostics, logistic
from barloom.operators import models as M
from barloom.operators import splits
from barloom.params import ResearchParams, TuningParams

NAMES = ["a", "b", "flat", "big"]
C = [0.001, 0.01, 0.1, 1.0, 10.0]
GRIDS = {"logreg_none": {}, "logreg_l1": {"grid": {"C": C}}, "logreg_l2": {"grid": {"C": C}}}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    n = 1200
    x = np.column_stack([r.normal(size=n), r.normal(size=n), np.full(n, 2.5), 1000 * r.normal(size=n) + 5])
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-(x[:, 0] - 0.6 * x[:, 1] - 1)))).astype(int)
    data = [(k // 2, f"T{k % 2}", *map(float, x[k]), int(y[k])) for k in range(n)]
    df = spark.createDataFrame(data, "ordinal int, ticker string, a double, b double, flat double, big double, target int")
    df = df.select(F.date_add(F.lit("2020-01-01").cast("date"), "ordinal").alias("date"), "ticker", "ordinal",
                   array_to_vector(F.array(*NAMES)).alias("features"), "target", F.lit(0.01).alias("fwd_ret")).repartition(5).persist()
    df.count()
    return df


def spark_ml(rows, penalty, c):
    """Spark ML's solution of the same problem, on features scaled beforehand."""
    x = np.array([r.features.toArray() for r in rows.collect()])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    n, ups = rows.agg(F.count("*"), F.sum("target")).first()
    scaled = F.udf(lambda v: [float(a) for a in (v.toArray() - mean) / sd], "array<double>")
    weight = F.when(F.col("target") == 1, n / (2 * ups)).otherwise(n / (2 * (n - ups)))
    prepared = rows.select(array_to_vector(scaled("features")).alias("features"), "target", weight.alias("weight"))
    model = LogisticRegression(
        labelCol="target", weightCol="weight", standardization=False, maxIter=3000, tol=1e-12,
        regParam=0.0 if penalty == "none" else 1 / (c * n), elasticNetParam=1.0 if penalty == "l1" else 0.0).fit(prepared)
    b = model.coefficients.toArray() / sd
    return b, model.intercept - b @ mean


@pytest.mark.parametrize("penalty,c", [("none", 1.0), ("l2", 0.001), ("l2", 1.0), ("l1", 0.01), ("l1", 1.0)])
def test_coefficients_equal_those_of_spark_ml(rows, penalty, c):
    s = logistic.fit_many(rows, [logistic.Job(penalty, c)])[0]
    b, a = spark_ml(rows, penalty, c)
    sd = np.array([1, 1, 1, 1000])
    assert np.abs((s.coefficients - b) * sd).max() < 1e-4 and abs(s.intercept - a) < 1e-4
    assert s.violation <= logistic.TOLERANCE and s.coefficients[2] == 0.0


def test_fits_side_by_side_equal_fits_alone_in_as_many_jobs(spark, rows):
    spans = [(0, 200), (0, 400), (100, 600)]
    jobs = [logistic.Job(p, c, s) for p in ("none", "l1", "l2") for c in ((1.0,) if p == "none" else C) for s in spans]
    jobs += [logistic.Job("l2", 1.0, (0, 300), balanced=False)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("side by side", "")
    together = logistic.fit_many(rows, jobs)
    used = len(tracker.getJobIdsForGroup("side by side"))
    spark.sparkContext.setJobGroup("other", "")
    assert used <= 3 * (max(s.iterations for s in together) + 1)
    for k in (0, 4, 9, 17, 23, 33):
        alone = logistic.fit_many(rows.where((F.col("ordinal") >= jobs[k].span[0]) & (F.col("ordinal") < jobs[k].span[1])), [
            logistic.Job(jobs[k].penalty, jobs[k].c, balanced=jobs[k].balanced)])[0]
        assert np.abs((alone.coefficients - together[k].coefficients) * [1, 1, 1, 1000]).max() < 1e-8
        assert alone.intercept == pytest.approx(together[k].intercept, abs=1e-8) and alone.rows == together[k].rows


def test_one_class_no_rows_and_separable_rows(spark, rows):
    assert logistic.fit_many(rows.where("target = 1"), [logistic.Job("l2")])[0].coefficients is None
    none = logistic.fit_many(rows, [logistic.Job("l1", 1.0, (5000, 6000))])[0]
    assert none.coefficients is None and none.rows == 0 and none.prior == 0.0
    apart = spark.createDataFrame([(float(k), int(k > 4)) for k in range(10)], "x double, target int").select(
        array_to_vector(F.array("x")).alias("features"), "target")
    s = logistic.fit_many(apart, [logistic.Job("none"), logistic.Job("l2")], most=30)
    assert s[0].iterations <= 30 and s[0].coefficients[0] > 1 and s[1].violation <= logistic.TOLERANCE


def test_first_order_conditions_hold_for_each_penalty(rows):
    specs = M.model_specs(ResearchParams(models=GRIDS | {n: {"enabled": False} for n in ("random_forest", "xgboost", "majority")}))
    for name, spec in specs.items():
        params = {"C": 0.01} if spec.grid else {}
        fitted = M.fit(spec, params, rows)
        got = diagnostics.stationarity(fitted, spec, params, rows, NAMES).collect()
        assert {r.feature for r in got} == {"a", "b", "big", "(intercept)"}
        assert all(r.score_moment == pytest.approx(r.label_moment, abs=1e-9) for r in got), name
        worse = M.fit(spec, {"C": 0.5} if spec.grid else {}, rows.where("ordinal < 300"))
        off = diagnostics.stationarity(M.Fitted(worse.model, fitted.prior, fitted.rows), spec, params, rows, NAMES).collect()
        assert any(abs(r.score_moment - r.label_moment) > 1e-4 for r in off), name


def test_search_scores_equal_single_fits(rows):
    spec = M.model_specs(ResearchParams(models=GRIDS))["logreg_l2"]
    folds = splits.cv_folds(splits.date_axis(rows), 3, 1).collect()
    scores = {(c, f): s for c, f, s in M.cv_scores(spec, rows, folds, TuningParams(cv_splits=3))}
    assert len(scores) == 15
    for c, fold in ((0, folds[0]), (3, folds[2])):
        i = F.col("ordinal")
        fitted = M.fit(spec, {"C": C[c]}, rows.where((i >= fold["train_from"]) & (i < fold["train_to"])))
        test = M.with_probability(fitted, rows.where((i >= fold["test_from"]) & (i < fold["test_to"]))).withColumn("one", F.lit(1))
        assert M.grouped_scores(test, TuningParams().scoring, ("one",)).first()["score"] == pytest.approx(scores[c, fold["fold"]], abs=1e-9)
    tuned = M.tune(spec, rows, folds, TuningParams(cv_splits=3))
    again = M.fit(spec, tuned.best_params, rows).model.stages[-1]
    assert np.allclose(tuned.fitted.model.stages[-1].coefficients.toArray(), again.coefficients.toArray(), atol=1e-9)


def test_a_prefix_of_boosting_is_the_smaller_fit(rows):
    specs = M.model_specs(ResearchParams(models={
        "xgboost": {"grid": {"learning_rate": [0.2], "max_depth": [2], "n_estimators": [6, 3], "subsample": [0.7, 1.0]}},
        "random_forest": {"grid": {"n_estimators": [4, 9], "max_depth": [3], "min_samples_leaf": [5, 50], "max_features": ["sqrt"]}}}))
    boosting, forest = specs["gbt[mllib]"], specs["random_forest"]
    probs = lambda f: [r.prob_up for r in M.with_probability(f, rows).orderBy("date", "ticker").collect()]
    for share in (0.7, 1.0):
        point = {"learning_rate": 0.2, "max_depth": 2, "subsample": share}
        large, small = (M.fit(boosting, point | {"n_estimators": n}, rows) for n in (6, 3))
        assert M.first_trees(large, 3).model.stages[-1].getNumTrees == 3
        assert probs(M.first_trees(large, 3)) == probs(small) != probs(large)
    whole = M.fit(forest, {"n_estimators": 9, "max_depth": 3, "min_samples_leaf": 5, "max_features": "sqrt"}, rows)
    part = M.first_trees(whole, 4)
    votes = [t.transform(rows.orderBy("date", "ticker").limit(1)).select("probability").first()[0].toArray() for t in whole.model.stages[-1].trees[:4]]
    assert probs(part)[0] == pytest.approx(np.mean([v[1] / v.sum() for v in votes]))
    with pytest.raises(ValueError):
        M.first_trees(whole, 10)
    assert [(g["n_estimators"], s) for g, s in M._ensembles(forest.combinations())] == [(9, {0: 4, 2: 9}), (9, {1: 4, 3: 9})]


def test_search_over_ensembles_scores_each_point(rows):
    spec = M.model_specs(ResearchParams(models={"xgboost": {"grid": {"learning_rate": [0.2], "max_depth": [2], "n_estimators": [5, 2]}}}))["gbt[mllib]"]
    folds = splits.cv_folds(splits.date_axis(rows), 2, 1).collect()
    scores = {(c, f): s for c, f, s in M.cv_scores(spec, rows, folds, TuningParams(cv_splits=2, parallelism=2))}
    i, fold = F.col("ordinal"), folds[1]
    for c, n in ((0, 5), (1, 2)):
        fitted = M.fit(spec, {"learning_rate": 0.2, "max_depth": 2, "n_estimators": n}, rows.where((i >= fold["train_from"]) & (i < fold["train_to"])))
        test = M.with_probability(fitted, rows.where((i >= fold["test_from"]) & (i < fold["test_to"]))).withColumn("one", F.lit(1))
        assert M.grouped_scores(test, TuningParams().scoring, ("one",)).first()["score"] == pytest.approx(scores[c, 1], abs=1e-9)
