import duckdb
import pytest

import __spark_entry__ as entry
from barloom.operators import boosting, models
from barloom.params import DEFAULT_MODELS, ResearchParams
from barloom.plans import catalog, inputs
from tools.check import TABLES, rows_of

# A cross-section of the registered queries; tools/check.py runs them all.
NAMES = ["clean_bars", "feature_panel", "walk_forward_folds", "trade_list_long_short", "backtest_table", "roc_points"]


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    relation = db.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in relation.description], relation.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 14
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_model_queries_search_the_default_grids():
    for name, family in (("random_forest", "random_forest"), ("gbt[mllib]", "xgboost")):
        grid = catalog.SPECS[name].grid
        assert grid and all(list(grid[k]) == list(DEFAULT_MODELS[family]["grid"][k]) for k in grid)
    assert len(catalog.SPECS["gbt[mllib]"].combinations()) == 32 and len(catalog.SPECS["random_forest"].combinations()) == 24


def test_walk_forward_refits_every_block_of_test_days(spark, small, monkeypatch):
    monkeypatch.setattr(catalog, "SPECS", {"majority": catalog.SPECS["majority"]})
    rows = catalog._forward(spark, small).cache()
    days = inputs.axis(spark, small).count() - inputs.PARAMS.walk_forward.min_train_days
    assert rows.select("fold").distinct().count() == -(-days // inputs.PARAMS.walk_forward.test_days) > 1
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS FROM '{small}/{t}.parquet'")
    relation = db.execute(f"SELECT * FROM ({entry.oracle_sql()['walk_forward_coverage']}) WHERE model = 'majority'")
    got = catalog._coverage(rows)
    assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in relation.description], relation.fetchall())
    rows.unpersist()


def test_walk_forward_searches_without_final_fits(spark, small, monkeypatch):
    """It needs the parameters that tuning picks, not the tuned models; forests and boosting start from the same cut points."""
    grids = {name: {"enabled": False} for name in ("majority", "logreg_none", "logreg_l2")} | {
        "logreg_l1": {"grid": {"C": [0.01, 1.0]}}, "random_forest": {"grid": {"n_estimators": [3], "max_depth": [1, 3]}},
        "xgboost": {"grid": {"learning_rate": [0.1, 0.3], "max_depth": [2], "n_estimators": [2, 4]}}}
    monkeypatch.setattr(catalog, "SPECS", models.model_specs(ResearchParams(models=grids)))
    monkeypatch.setattr(catalog, "_tuned_once", {})
    monkeypatch.setattr(catalog, "_best_once", {})
    want = {name: catalog._search(spark, small, name).best_params for name in catalog.SPECS}
    cut, found = boosting.span_facts, []
    monkeypatch.setattr(boosting, "span_facts", lambda *args: found.append(1) or cut(*args))
    for step in ("_grown", "_solved"):
        monkeypatch.setattr(models, step, lambda *_: pytest.fail("a final fit"))
    rows = catalog._forward(spark, small)
    assert {spec.name: params for spec, params in catalog._best(spark, small, list(catalog.SPECS))} == want
    assert len(found) == 2  # of the folds, of the refits
    counts = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
    assert set(counts) == set(want) and len(set(counts.values())) == 1
