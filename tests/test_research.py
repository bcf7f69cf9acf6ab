from barloom.operators import cleaning, panel
from barloom.params import (
    BacktestParams, DataParams, EvaluationParams, ImportanceParams, ResearchParams, TuningParams, WalkForwardParams,
)
from barloom.plans import research
from barloom.sources import tpch
from barloom.sources.session import shared_folder

PARAMS = ResearchParams(
    data=DataParams(tickers=("PROMO", "LARGE", "STANDARD", "NOSUCH"), market_ticker="STANDARD", min_rows=100),
    walk_forward=WalkForwardParams(min_train_days=300, test_days=200), backtest=BacktestParams(),
    tuning=TuningParams(cv_splits=2, parallelism=2),
    evaluation=EvaluationParams(permutation_importance=ImportanceParams(n_repeats=2)),
    models={
        "majority": {}, "logreg_none": {"enabled": False}, "logreg_l1": {"enabled": False},
        "logreg_l2": {"max_iter": 20, "grid": {"C": [0.01, 1.0]}},
        "random_forest": {"grid": {"n_estimators": [5], "max_depth": [2], "min_samples_leaf": [20], "max_features": ["sqrt"]}},
        "xgboost": {"enabled": False},
    },
)


def test_whole_study(spark, small):
    out = shared_folder(spark)
    bars = cleaning.with_order(tpch.daily_bars(spark, small))
    result = research.run(spark, bars, PARAMS, out)
    manifest = {r.ticker: r.status for r in spark.read.json(f"{out}/manifest").collect()}
    assert manifest == {"PROMO": "ok", "LARGE": "ok", "STANDARD": "ok", "NOSUCH": "failed"}
    scores = result["classification"].collect()
    models = {"majority", "logreg_l2", "random_forest"}
    assert {(r.split, r.model) for r in scores} == {(s, m) for s in ("validation", "test", "walk_forward") for m in models}
    selection = spark.read.json(f"{out}/tables/model_selection/json").collect()
    chosen = [r.model for r in selection if r.selected]
    best = min((r for r in scores if r.split == "validation" and r.model != "majority"), key=lambda r: r.log_loss)
    assert chosen == [best.model]
    strategies = {r.strategy for r in result["backtest"].where("split = 'test'").collect()}
    assert strategies == models | {"always_long", "ma_rule_50d", "buy_and_hold"}
    assert result["sensitivity"].count() == 10 and result["verdict"].count() == 1
    assert result["per_ticker"].count() == 6 and result["importance_permutation"].count() == 48
    assert {r.kind for r in result["importance_native"].select("kind").distinct().collect()} == {"coef", "impurity"}
    assert not result["diagnostics"].where("model = 'majority' and degenerate").count()
    keys = {r.key for r in spark.read.json(f"{out}/models/metadata").collect()}
    assert {"seed", "selected_model", "feature_columns", "splits", "walk_forward_folds", "models", "data_source"} <= keys
    for name, table in result.items():
        assert table.columns, name
    stored = research.build(spark, PARAMS, out)
    assert panel.feature_columns(stored) == panel.feature_names(PARAMS.features)
