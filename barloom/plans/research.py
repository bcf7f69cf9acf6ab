"""The whole study as one application: ingest, panel, train, evaluate.

Each stage reads the table the stage before it wrote, so every cut point is durable, any
stage can be run again on its own, and a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import (
    backtest, cleaning, diagnostics, importance, metrics, models, panel, series, splits,
)
from barloom.params import ResearchParams
from barloom.sources import bars as bar_files
from barloom.sources import tables
from barloom.sources.session import tune

BASELINE = "majority"


def ingest(spark: SparkSession, raw: DataFrame, params: ResearchParams, out: str) -> DataFrame:
    """Clean a raw universe into the bars table and write its manifest."""
    done = cleaning.ingest(raw, params.data, params.features.market_features.enabled,
                           lambda candidates: _keep(spark, candidates, f"{out}/daily_candidates"))
    done.manifest.write.mode("overwrite").json(f"{out}/manifest")
    manifest = spark.read.schema(done.manifest.schema).json(f"{out}/manifest")
    universe = params.data.universe()
    cleaning.Ingested(done.bars, manifest).require_usable(universe)
    market = params.data.market()
    if params.features.market_features.enabled and manifest.where(
        (F.col("ticker") == market) & (F.col("status") == "ok")
    ).isEmpty():
        raise cleaning.DataError(f"market features need usable bars of {market}")
    bar_files.write_bars(done.bars, f"{out}/bars")
    return bar_files.read_bars(spark, f"{out}/bars")


def build(spark: SparkSession, params: ResearchParams, out: str, rebuild: bool = False) -> DataFrame:
    """The panel table, built from the stored bars when needed."""
    make = lambda: panel.build_panel(bar_files.read_bars(spark, f"{out}/bars"), params)
    return tables.load_panel(spark, f"{out}/features", make, params, rebuild)


@dataclass
class Training:
    tuned: dict[str, models.Tuned]
    selected: str
    beats_baseline: bool
    predictions: DataFrame
    features: list[str]


def train(spark: SparkSession, params: ResearchParams, out: str) -> Training:
    """Tune on train, select on validation, refit on both, predict test once, walk forward."""
    rows = build(spark, params, out)
    names = panel.feature_columns(rows)
    axis = splits.date_axis(rows)
    segments = splits.date_segments(axis, params)
    summary = splits.segment_summary(segments)
    tables.save_table(summary, f"{out}/tables/splits")
    splits.assert_chronological(summary)
    # Laid out by date, so every segment and fold filter skips the files it does not need.
    splits.tag_rows(rows, segments, "ordinal", "split").repartitionByRange("ordinal", "ticker").sortWithinPartitions(
        "ordinal", "ticker").write.mode("overwrite").parquet(f"{out}/tagged")
    vectors = models.assemble(spark.read.parquet(f"{out}/tagged"), names)

    specs = models.model_specs(params)
    train_rows = vectors.where("split = 'train'")
    validation, test = vectors.where("split = 'validation'"), vectors.where("split = 'test'")
    train_axis = splits.date_axis(train_rows)
    folds = splits.cv_folds(train_axis, params.tuning.cv_splits, params.cv_gap()).collect()  # k rows
    tuned = {n: models.tune(s, train_rows, folds, params.tuning) for n, s in specs.items()}
    parts = [models.predictions(t.spec, t.fitted, validation, "validation", params.backtest.threshold) for t in tuned.values()]

    development = ["train", "validation"] if params.evaluation.refit_on_train_val else ["train"]
    dev_rows = vectors.where(F.col("split").isin(development))
    final = {n: models.fit(t.spec, t.best_params, dev_rows) for n, t in tuned.items()}
    parts += [models.predictions(specs[n], f, test, "test", params.backtest.threshold) for n, f in final.items()]
    for folder, fitted in (("train_fit", {n: t.fitted for n, t in tuned.items()}), ("final_fit", final)):
        tables.save_models({n: f.model for n, f in fitted.items() if f.model}, f"{out}/models/{folder}")
    tables_out = reduce(DataFrame.unionByName, parts).withColumn("fold", F.lit(None).cast("int"))

    wf, forward_folds = params.walk_forward, []
    if wf.enabled:
        scope = splits.development_rows(vectors, wf.scope).drop("ordinal")
        scope_axis = splits.date_axis(scope)
        wf_folds = splits.walk_forward_folds(scope_axis, wf.min_train_days, wf.test_days, params.purge_days())
        fold_table = splits.fold_table(wf_folds, scope_axis)
        tables.save_table(fold_table, f"{out}/tables/walk_forward_folds")
        forward_folds = fold_table.orderBy("fold").collect()  # one row per block
        frozen = [(t.spec, t.best_params) for t in tuned.values()]
        numbered = splits.tag_rows(scope, scope_axis, "ordinal")
        forward = models.walk_forward_predictions(
            frozen, numbered, wf_folds.collect(), params.backtest.threshold  # one row per block
        )
        tables_out = tables_out.unionByName(forward)
    tables.save_predictions(tables_out, f"{out}/predictions")

    stored = tables.load_predictions(spark, f"{out}/predictions")
    scored = metrics.classification_table(stored.where("split = 'validation'"))
    selection = metrics.select_model(scored, params.tuning.selection_metric, BASELINE, list(specs))
    tables.save_table(selection, f"{out}/tables/model_selection")
    tables.save_table(models.model_table(spark, list(tuned.values()), params.tuning.scoring), f"{out}/tables/models")
    for name, t in tuned.items():
        if t.results is not None:
            tables.save_table(t.results, f"{out}/tables/tuning_{tables.safe_name(name)}")
    row = selection.where("selected").select("model", params.tuning.selection_metric, "selected_beats_majority").first()
    record = run_record(params, names, summary, forward_folds, tuned, row)
    metadata_table(spark, record).write.mode("overwrite").json(f"{out}/models/metadata")
    return Training(tuned, row[0], bool(row[2]), stored, names)


def run_record(params: ResearchParams, names: list[str], summary: DataFrame, forward_folds: list, tuned: dict[str, models.Tuned], selected) -> dict:
    """What a run used and found: parameters, features, splits, folds, every model's choice and score; `selected` has the
    best model, its validation score and whether it beats the baseline."""
    return {
        "seed": params.seed, "purge_days": params.purge_days(), "feature_columns": names,
        "selection_metric": params.tuning.selection_metric, "selected_model": selected[0],
        "selected_validation_score": selected[1], "selected_beats_majority_on_validation": selected[2],
        "refit_on_train_val": params.evaluation.refit_on_train_val, "data_source": params.data.source,
        "splits": [_plain(r) for r in summary.collect()],  # three rows
        "walk_forward_folds": [_plain(r) for r in forward_folds],
        "models": {n: {
            "family": t.spec.family, "estimator": t.spec.estimator, "grid": dict(t.spec.grid), "best_params": t.best_params,
            "cv_score": t.cv_score, "cv_scoring": params.tuning.scoring, "note": t.spec.note, "single_class": t.fitted.model is None,
        } for n, t in tuned.items()},
    }


def _plain(row) -> dict:
    return {k: v if isinstance(v, (int, float, str, type(None))) else str(v) for k, v in row.asDict().items()}


def metadata_table(spark: SparkSession, record: dict) -> DataFrame:
    """The run record as one (key, value) row per entry."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in record.items()], "key string, value string")


def native_importances(tuned: dict[str, models.Tuned], train_rows: DataFrame, features: list[str], path: str) -> DataFrame | None:
    """Coefficients, impurity or gain of every model that has them, one table; tree nodes are stored below `path`."""
    parts, spark = [], train_rows.sparkSession
    for name, t in tuned.items():
        if t.fitted.model is None:
            continue
        if t.spec.family == "logistic":
            parts.append(importance.logistic_coefficients(name, t.fitted.model, train_rows, features))
        elif t.spec.estimator == "GBTClassifier":
            parts.append(importance.tree_importance(name, "gain", t.fitted.model, spark, features, f"{path}/{tables.safe_name(name)}"))
        else:
            parts.append(importance.tree_importance(name, "impurity", t.fitted.model, spark, features))
    return reduce(DataFrame.unionByName, parts) if parts else None


def all_importances(
    spark: SparkSession, training: Training, params: ResearchParams, out: str
) -> tuple[DataFrame, DataFrame]:
    """(native, permutation) tables of the train-fitted models, scored on validation rows."""
    vectors = models.assemble(spark.read.parquet(f"{out}/tagged"), training.features)
    train_rows, validation = vectors.where("split = 'train'"), vectors.where("split = 'validation'")
    permuted, p = [], params.evaluation.permutation_importance
    native = native_importances(training.tuned, train_rows, training.features, f"{out}/models/nodes")
    for name, t in training.tuned.items():
        if p.enabled and t.fitted.model is not None:
            permuted.append(importance.permutation_importance(
                name, t.fitted, validation, training.features, p.n_repeats, params.seed, p.scoring, p.max_rows))
    join = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return native, join(permuted)


def evaluate(spark: SparkSession, training: Training, params: ResearchParams, out: str) -> dict[str, DataFrame]:
    """Every evaluation table, stored under `tables/` and read back."""
    bt = params.backtest
    rows = spark.read.parquet(f"{out}/features/panel")
    preds = tables.load_predictions(spark, f"{out}/predictions").drop("fold")
    key_model = next(iter(training.tuned))
    frame = backtest.benchmark_frame(preds, rows, key_model, bt)
    strategies = backtest.model_signals(preds, bt).unionByName(backtest.benchmark_signals(frame, bt))
    daily = _keep(spark, backtest.daily_series(strategies, frame, bt), f"{out}/tables/daily_returns")
    native, permuted = all_importances(spark, training, params, out)
    result = {"daily_returns": daily}
    if native is not None:
        result["importance_native"] = _keep(spark, native, f"{out}/tables/importance_native")
    if permuted is not None:
        result["importance_permutation"] = _keep(spark, permuted, f"{out}/tables/importance_permutation")
    test = preds.where("split = 'test'")
    lazily = {
        "classification": metrics.classification_table(preds),
        "backtest": backtest.backtest_table(preds, rows, key_model, bt),
        "diagnostics": diagnostics.model_diagnostics(
            test, daily.where("split = 'test'"), bt, result.get("importance_native"), BASELINE),
        "sensitivity": backtest.sensitivity_table(test, training.selected, bt),
        "per_ticker": backtest.per_ticker_table(test, training.selected, bt),
        "equity_curves": series.equity_curves(daily),
        "rolling_volatility": series.rolling_volatility(daily, bt.rolling_vol_window, bt.periods_per_year),
        "confusion": series.confusion_shares(metrics.confusion_counts(preds)),
        "roc": series.roc_points(preds),
        "calibration": series.calibration_curve(preds, baseline=BASELINE),
        "histogram": series.probability_histogram(preds, baseline=BASELINE),
    }
    for name, table in lazily.items():
        result[name] = _keep(spark, table, f"{out}/tables/{name}")
    names = [backtest.BUY_AND_HOLD, backtest.ALWAYS_LONG, bt.ma_rule(), BASELINE]
    tested = result["backtest"].where("split = 'test'")
    conclusions = {
        "comparison": diagnostics.benchmark_comparison(tested, training.selected, names),
        "verdict": diagnostics.verdict(
            tested, result["diagnostics"], result["sensitivity"], training.selected, bt.cost_bps,
            params.data.source == "sample"),
        "best_live_model": diagnostics.best_live_model(
            result["classification"], result["diagnostics"], result["backtest"], BASELINE),
    }
    for name, table in conclusions.items():
        result[name] = _keep(spark, table, f"{out}/tables/{name}")
    return result


def _keep(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run(spark: SparkSession, raw: DataFrame, params: ResearchParams, out: str) -> dict[str, DataFrame]:
    tune(spark)
    ingest(spark, raw, params, out)
    build(spark, params, out, rebuild=True)
    training = train(spark, params, out)
    return evaluate(spark, training, params, out)
