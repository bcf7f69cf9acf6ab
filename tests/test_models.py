import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from barloom.operators import importance as I
from barloom.operators import models as M
from barloom.operators import splits
from barloom.params import ResearchParams, TuningParams
from barloom.sources import tables
from barloom.sources.session import shared_folder

NAMES = ["signal", "weak", "noise"]
GRIDS = {
    "logreg_none": {"max_iter": 50}, "logreg_l1": {"max_iter": 100, "grid": {"C": [0.0001, 1.0]}},
    "logreg_l2": {"max_iter": 50, "grid": {"C": [1.0]}},
    "random_forest": {"grid": {"n_estimators": [10], "max_depth": [3], "min_samples_leaf": [5], "max_features": ["sqrt"]}},
    "xgboost": {"grid": {"learning_rate": [0.3], "max_depth": [2], "n_estimators": [5], "reg_lambda": [1.0, 2.0]}},
}
PARAMS = ResearchParams(models=GRIDS)


@pytest.fixture(scope="module")
def planted(spark):
    """Label drawn from a known logistic function of two features; the third is noise."""
    rng = np.random.default_rng(11)
    n = 1500
    x = rng.normal(size=(n, 3)) * [1.0, 1.0, 5.0]
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 0.7 * x[:, 1])))).astype(int)
    rows = [(k // 3, f"T{k % 3}", *map(float, x[k]), int(y[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "ordinal int, ticker string, signal double, weak double, noise double, target int")
    return df.select(
        F.date_add(F.lit("2020-01-01").cast("date"), "ordinal").alias("date"), "ticker", "ordinal",
        array_to_vector(F.array(*NAMES)).alias("features"), "target", F.lit(0.01).alias("fwd_ret"),
    ).persist()


def auc(spec, fitted, rows):
    from barloom.operators.metrics import roc_auc

    return roc_auc(M.predictions(spec, fitted, rows, "test")).first().roc_auc


def test_registry():
    specs = M.model_specs(PARAMS)
    assert list(specs) == ["majority", "logreg_none", "logreg_l1", "logreg_l2", "random_forest", "gbt[mllib]"]
    assert "reg_lambda" in specs["gbt[mllib]"].note and len(specs["gbt[mllib]"].combinations()) == 1
    off = {name: {"enabled": False} for name in ("majority", *GRIDS)}
    with pytest.raises(ValueError):
        M.model_specs(ResearchParams(models=off))
    assert tables.safe_name("gbt[mllib]") == "gbt_mllib"


def test_all_families_find_the_planted_signal(planted):
    specs = M.model_specs(PARAMS)
    train, test = planted.where("ordinal < 400"), planted.where("ordinal >= 400")
    for name, spec in specs.items():
        fitted = M.fit(spec, spec.combinations()[-1] if spec.grid else {}, train)
        score = auc(spec, fitted, test)
        assert score == 0.5 if name == "majority" else score > 0.8, name
    prior = M.fit(specs["majority"], {}, train).prior
    assert prior == pytest.approx(train.agg(F.avg("target")).first()[0])


def test_strong_penalty_gives_a_constant_on_the_threshold(planted):
    spec = M.model_specs(PARAMS)["logreg_l1"]
    fitted = M.fit(spec, {"C": 0.00001}, planted)
    probs = {r.prob_up for r in M.with_probability(fitted, planted).select("prob_up").distinct().collect()}
    assert probs == {0.5}
    table = I.logistic_coefficients("logreg_l1", fitted.model, planted, NAMES)
    assert table.where("coef_raw_units <> 0").isEmpty()


def test_single_class_training_falls_back_to_the_prior(planted):
    spec = M.model_specs(PARAMS)["logreg_l2"]
    fitted = M.fit(spec, {"C": 1.0}, planted.where("target = 0"))
    assert fitted.model is None and fitted.prior == 0.0


def test_tuning_trains_on_the_past_only_and_is_reproducible(planted):
    spec = M.model_specs(PARAMS)["logreg_l1"]
    folds = splits.cv_folds(splits.date_axis(planted), 3, 1).collect()
    assert all(f.train_to < f.test_from for f in folds)
    a, b = (M.tune(spec, planted, folds, TuningParams(cv_splits=3, parallelism=2)) for _ in range(2))
    assert a.best_params == b.best_params == {"C": 1.0} and a.cv_score == b.cv_score
    ranks = {r.params: r.rank_test_score for r in a.results.collect()}
    assert ranks == {'{"C": 1.0}': 1, '{"C": 0.0001}': 2}
    one, two = (M.predictions(spec, t.fitted, planted, "x").orderBy("date", "ticker").collect() for t in (a, b))
    assert one == two


def test_coefficients_and_permutation_rank_the_signal_first(planted):
    spec = M.model_specs(PARAMS)["logreg_none"]
    fitted = M.fit(spec, {}, planted)
    rows = {r.feature: r for r in I.logistic_coefficients("m", fitted.model, planted, NAMES).collect()}
    assert rows["signal"].coef_per_sd == pytest.approx(2.0, abs=0.4) and rows["weak"].coef_per_sd < -0.4
    assert rows["noise"].coef_raw_units == pytest.approx(rows["noise"].coef_per_sd / rows["noise"].feature_sd)
    table = I.permutation_importance("m", fitted, planted, NAMES, n_repeats=3)
    drop = {r.feature: r.importance_mean for r in table.collect()}
    assert drop["signal"] > 0.2 > drop["weak"] > abs(drop["noise"])
    assert I.significant_features(table).first().features == 3


def test_rows_are_numbered_without_gaps(planted):
    seen = I.numbered(planted.select("date", "ticker")).agg(F.min("_at"), F.max("_at"), F.count_distinct("_at")).first()
    n = planted.count()
    assert tuple(seen) == (0, n - 1, n)


def test_permuted_positions_are_permutations_of_any_size(spark):
    for n in (1, 2, 3, 10, 97, 1500):
        moved = spark.range(n).select("id", *(I.permuted_position(F.col("id"), F.lit(n), F.lit(k), F.lit(7)).alias(f"p{k}") for k in range(3))).collect()
        for k in range(3):
            assert sorted(r[f"p{k}"] for r in moved) == list(range(n))
        if n > 90:
            for a, b in (("id", "p0"), ("p0", "p1"), ("p1", "p2")):
                assert abs(np.corrcoef([r[a] for r in moved], [r[b] for r in moved])[0, 1]) < 0.3
                assert sum(r[a] == r[b] for r in moved) < 12


def test_permutation_over_the_newest_rows_only(planted):
    got = I.newest_rows(planted.select("date", "ticker", "ordinal"), 100).orderBy("date", "ticker").collect()
    want = planted.select("date", "ticker", "ordinal").orderBy("date", "ticker").collect()[-100:]
    assert got == want
    assert I.newest_rows(planted, None).count() == I.newest_rows(planted, 10**9).count() == planted.count()


def test_permutation_scores_follow_the_bijection(planted):
    """Scores recomputed from the positions, feature by feature."""
    from plain import auc as plain_auc

    spec = M.model_specs(PARAMS)["logreg_none"]
    fitted = M.fit(spec, {}, planted)
    got = {(r["index"], r["repeat"]): r["score"] for r in I.permutation_scores("m", fitted, planted, NAMES, 2, 5).collect()}
    rows = I.numbered(planted).orderBy("_at").collect()
    n = len(rows)
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([r.target for r in rows])
    last = fitted.model.stages[-1]
    for repeat in range(2):
        to = planted.sparkSession.range(n).orderBy("id").select(I.permuted_position(F.col("id"), F.lit(n), F.lit(repeat), F.lit(5)).alias("p")).collect()
        for j in range(3):
            z = x.copy()
            z[[r.p for r in to], j] = x[:, j]
            assert got[j, repeat] == pytest.approx(plain_auc(y, z @ last.coefficients.toArray() + last.intercept), abs=1e-12)


def test_tree_importance_reads_the_nodes(spark, planted):
    spec = M.model_specs(PARAMS)["gbt[mllib]"]
    fitted = M.fit(spec, spec.combinations()[0], planted)
    rows = I.tree_importance("gbt", "gain", fitted.model, spark, NAMES, shared_folder(spark)).collect()
    best = max(rows, key=lambda r: r.value)
    assert best.feature == "signal" and sum(r.value for r in rows) == pytest.approx(1.0)
    assert sum(r.split_count for r in rows) > 5


def test_models_survive_a_round_trip(spark, planted):
    spec = M.model_specs(PARAMS)["random_forest"]
    fitted = M.fit(spec, spec.combinations()[0], planted)
    path = shared_folder(spark)
    tables.save_models({"random_forest": fitted.model}, path)
    back = tables.load_models(spark, path, ["random_forest", "absent"])
    assert list(back) == ["random_forest"]
    again = M.Fitted(back["random_forest"], fitted.prior, fitted.rows)
    a, b = (M.with_probability(f, planted).select("date", "ticker", "prob_up") for f in (fitted, again))
    assert a.exceptAll(b).isEmpty()
