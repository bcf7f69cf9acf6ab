"""Model zoo: specs, time-series tuning, fixed-parameter fits, predictions.

Features are assembled into a vector once. All logistic models of a search (grid points, folds and the final fits) move
together, one job an iteration (`logistic`), and so do all boosted ensembles and forests, one job a tree level (`boosting`,
`forests`). One fit of the largest ensemble serves every smaller number of trees of the grid, since its first n trees are an ensemble of n.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import boosting, forests, logistic
from barloom.operators.baseline import class_weights
from barloom.operators.metrics import clipped, roc_auc
from barloom.operators.panel import feature_columns
from barloom.params import ResearchParams, TuningParams

#: Default of the model parameter `max_bins`: candidate split points per feature of the tree learners.
MAX_BINS = 128
SNAP = 1e-12
# The boosting grid names with a counterpart.
BOOSTING_NAMES = ("learning_rate", "max_depth", "n_estimators", "subsample", "colsample_bytree")


@dataclass(frozen=True)
class ModelSpec:
    """An unfitted model; logistic ones have a penalty and `most` iterations, an `ensemble` ("boosting" or "forest") a seed and a number of bins."""

    name: str
    family: str
    grid: Mapping[str, list] = field(default_factory=dict)
    balanced: bool = False
    note: str = ""
    estimator: str = ""
    penalty: str = ""
    most: int = 100
    ensemble: str = ""
    seed: int = 42
    max_bins: int = MAX_BINS

    def job(self, params: Mapping[str, Any], span: tuple[int, int] = logistic.EVERYTHING) -> logistic.Job:
        return logistic.Job(self.penalty, float(params.get("C", 1.0)), span, self.balanced)

    def combinations(self) -> list[dict[str, Any]]:
        names = list(self.grid)
        return [dict(zip(names, values, strict=True)) for values in itertools.product(*self.grid.values())]


@dataclass
class Fitted:
    """A fitted model, or the prior alone when only one class was seen."""

    model: PipelineModel | None
    prior: float
    rows: int


@dataclass
class Tuned:
    spec: ModelSpec
    fitted: Fitted
    best_params: dict[str, Any]
    cv_score: float | None = None
    results: DataFrame | None = None


def model_specs(params: ResearchParams | None = None) -> dict[str, ModelSpec]:
    """The enabled models in declaration order."""
    params = params or ResearchParams()
    config, seed = params.models, params.seed
    on = lambda name: config.get(name, {}).get("enabled", True)
    specs: dict[str, ModelSpec] = {}
    if on("majority"):
        specs["majority"] = ModelSpec("majority", "baseline", estimator="prior")
    for kind in ("none", "l1", "l2"):
        name = f"logreg_{kind}"
        if on(name):
            c = config.get(name, {})
            grid = {} if kind == "none" else {"C": list(c.get("grid", {}).get("C", []))}
            specs[name] = ModelSpec(
                name, "logistic", {k: v for k, v in grid.items() if v},
                c.get("class_weight", "balanced") is not None, estimator="LogisticRegression",
                penalty=kind, most=int(c.get("max_iter", 2000)),
            )
    if on("random_forest"):
        c = config.get("random_forest", {})
        specs["random_forest"] = ModelSpec(
            "random_forest", "tree", dict(c.get("grid", {})),
            c.get("class_weight", "balanced_subsample") is not None,
            "class weights are balanced over all training rows, not per bootstrap sample",
            "RandomForestClassifier", ensemble="forest", seed=seed, max_bins=int(c.get("max_bins", MAX_BINS)),
        )
    c = config.get("xgboost", {})
    if on("xgboost") and c.get("allow_fallback", c.get("allow_sklearn_fallback", True)):
        grid = dict(c.get("grid", {}))
        dropped = [k for k in grid if k not in BOOSTING_NAMES]
        note = "Spark ML gradient boosting stands in; column sampling is per node"
        if dropped:
            note += f"; without counterpart: {', '.join(dropped)}"
        specs["gbt[mllib]"] = ModelSpec(
            "gbt[mllib]", "tree", {k: v for k, v in grid.items() if k in BOOSTING_NAMES}, False, note, "GBTClassifier",
            ensemble="boosting", seed=seed, max_bins=int(c.get("max_bins", MAX_BINS)),
        )
    if not specs:
        raise ValueError("no model is enabled")
    return specs


def assemble(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add the feature vector; everything a fit needs and nothing else."""
    names = names or feature_columns(panel)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(panel)
    extra = [c for c in ("ordinal", "split") if c in panel.columns]
    return vectors.select("date", "ticker", "features", "target", "fwd_ret", *extra)


def side_by_side(spark: SparkSession, work: list[Callable[[], Any]]) -> list[Any]:
    """Results of fits whose Spark jobs run at the same time."""
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


def _tree_facts(specs: list[ModelSpec], rows: DataFrame, spans: list[tuple[int, int]]) -> dict[int, Callable[[], tuple]]:
    """What the trees of all families start from, by number of bins; found once, by the family that asks first."""
    def once(bins):
        lock, found = Lock(), []

        def result():
            with lock:
                if not found:
                    found.append(boosting.range_facts(rows, spans, bins))
            return found[0]
        return result

    return {bins: once(bins) for bins in {s.max_bins for s in specs if s.ensemble}}


def _solved(spark, solution: logistic.Solution) -> Fitted:
    model = None if solution.coefficients is None else PipelineModel([logistic.spark_model(spark, solution)])
    return Fitted(model, solution.prior, solution.rows)


def _grow(spec: ModelSpec, rows: DataFrame, points: list[tuple[Mapping[str, Any], tuple[int, int]]],
          facts: Mapping[int, Callable[[], tuple]] | None = None) -> list:
    """Ensembles of all (parameters, span), grown side by side; `facts` as in `_tree_facts`."""
    known = facts[spec.max_bins]() if facts else None
    if spec.ensemble == "boosting":
        return boosting.fit_many(rows, [boosting.job(params, span) for params, span in points], spec.seed, spec.max_bins, facts=known)
    return forests.fit_many(rows, [forests.job(params, span) for params, span in points], spec.balanced, spec.seed, spec.max_bins, facts=known)


def _grown(spark, ensemble: boosting.Ensemble | forests.Forest) -> Fitted:
    make = boosting.spark_model if isinstance(ensemble, boosting.Ensemble) else forests.spark_model
    return Fitted(PipelineModel([make(spark, ensemble)]) if ensemble.trees else None, ensemble.prior, ensemble.rows)


def fit(spec: ModelSpec, params: Mapping[str, Any], rows: DataFrame) -> Fitted:
    """Fit on `rows` with fixed parameters."""
    if spec.penalty:
        return _solved(rows.sparkSession, logistic.fit_many(rows, [spec.job(params)], spec.most)[0])
    if spec.ensemble:
        return _grown(rows.sparkSession, _grow(spec, rows, [(params, logistic.EVERYTHING)])[0])
    counts = {r["target"]: r["n_class"] for r in class_weights(rows).collect()}  # two rows at most
    n = sum(counts.values())
    return Fitted(None, counts.get(1, 0) / n if n else 0.0, n)


def first_trees(fitted: Fitted, n: int) -> Fitted:
    """The ensemble of the first n trees. Boosting: what n iterations alone give; a forest: one of n trees."""
    if fitted.model is None:
        return fitted
    whole = fitted.model.stages[-1]
    if n == whole.getNumTrees:
        return fitted
    if not 0 < n <= whole.getNumTrees:
        raise ValueError(f"the ensemble has {whole.getNumTrees} trees, not {n}")
    java, gateway = whole._java_obj, SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml

    def first(values, kind):
        part = gateway.new_array(kind, n)
        for k in range(n):
            part[k] = values[k]
        return part

    if isinstance(whole, GBTClassificationModel):
        trees, weights = first(java.trees(), ml.regression.DecisionTreeRegressionModel), first(java.treeWeights(), gateway.jvm.double)
        part = GBTClassificationModel(ml.classification.GBTClassificationModel(whole.uid, trees, weights, java.numFeatures(), java.numClasses()))
    else:
        trees = first(java.trees(), ml.classification.DecisionTreeClassificationModel)
        part = RandomForestClassificationModel(ml.classification.RandomForestClassificationModel(whole.uid, trees, java.numFeatures(), java.numClasses()))
    return Fitted(PipelineModel([part]), fitted.prior, fitted.rows)


def with_probability(fitted: Fitted, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add prob_up; a value within 1e-12 of the threshold is put on it.

    Summation order must not decide a constant model's position.
    """
    if fitted.model is None:
        return rows.withColumn("prob_up", F.lit(float(fitted.prior)))
    p = vector_to_array("probability")[1]
    scored = fitted.model.transform(rows).drop("rawPrediction", "prediction")
    return scored.withColumn(
        "prob_up", F.when(F.abs(p - threshold) <= SNAP, F.lit(threshold)).otherwise(p)
    ).drop("probability")


def predictions(spec: ModelSpec, fitted: Fitted, rows: DataFrame, split: str, threshold: float = 0.5) -> DataFrame:
    """Tidy prediction rows of one model over one split."""
    return with_probability(fitted, rows, threshold).select(
        "date", "ticker", F.lit(split).alias("split"), F.lit(spec.name).alias("model"),
        "prob_up", "target", "fwd_ret",
    )


def _rates() -> dict[str, Column]:
    up, hit = F.col("prob_up") >= 0.5, F.col("target") == 1
    tp, fp = F.count_if(up & hit), F.count_if(up & ~hit)
    fn, tn = F.count_if(~up & hit), F.count_if(~up & ~hit)
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, y = clipped(), F.col("target")
    return {
        "neg_log_loss": -F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))),
        "neg_brier_score": -F.avg((p - y) * (p - y)),
        "accuracy": (tp + tn) / (tp + tn + fp + fn),
        "balanced_accuracy": (rate(tp, tp + fn) + rate(tn, tn + fp)) / 2.0,
        "precision": rate(tp, tp + fp),
        "recall": rate(tp, tp + fn),
        "f1": rate(2 * tp, 2 * tp + fp + fn),
    }


#: Higher is better for all of them.
SCORINGS = ("roc_auc", "neg_log_loss", "neg_brier_score", "accuracy", "balanced_accuracy", "precision", "recall", "f1")


def grouped_scores(scored: DataFrame, scoring: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, score) of rows with target and prob_up."""
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}; known are {', '.join(SCORINGS)}")
    if scoring == "roc_auc":
        return roc_auc(scored, keys).select(*keys, F.col("roc_auc").alias("score"))
    return scored.groupBy(*keys).agg(_rates()[scoring].alias("score"))


def _ensembles(combos: list[dict[str, Any]]) -> list[tuple[dict[str, Any], dict[int, int]]]:
    """(parameters of the largest ensemble, {combination: its number of trees}) of points that differ in that only."""
    found: dict[str, tuple[dict[str, Any], dict[int, int]]] = {}
    for c, params in enumerate(combos):
        rest = json.dumps({k: v for k, v in params.items() if k != "n_estimators"}, sort_keys=True)
        largest, sizes = found.setdefault(rest, (dict(params), {}))
        if "n_estimators" in params:
            sizes[c] = int(params["n_estimators"])
            largest["n_estimators"] = max(sizes.values())
        else:
            sizes[c] = 0
    return list(found.values())


def cv_scores(
    spec: ModelSpec, rows: DataFrame, folds: list, tuning: TuningParams, facts: Mapping[int, Callable[[], tuple]] | None = None
) -> list[tuple[int, int, float]]:
    """(combination, fold, score) of every grid point; rows need an `ordinal`."""
    if spec.penalty:
        return _logistic_search(spec, rows, folds, tuning)[0]
    if spec.ensemble:
        return _ensemble_search(spec, rows, folds, tuning, False, facts)[0]
    raise ValueError(f"{spec.name} has no grid to search")


def _logistic_search(spec: ModelSpec, rows: DataFrame, folds: list, tuning: TuningParams) -> tuple[list, list[logistic.Solution]]:
    """(scores as in cv_scores, the solutions of all grid points on all rows), fitted side by side."""
    combos = spec.combinations() or [{}]
    points = [(c, fold) for c in range(len(combos)) for fold in folds]
    jobs = [spec.job(combos[c], (fold["train_from"], fold["train_to"])) for c, fold in points] + [spec.job(p) for p in combos]
    solved = logistic.fit_many(rows, jobs, spec.most)
    scored = logistic.score_many(rows, {(c, fold["fold"]): (fold, s) for (c, fold), s in zip(points, solved)})
    scores = [(r["combination"], r["fold"], r["score"]) for r in grouped_scores(scored, tuning.scoring, ("combination", "fold")).collect()]
    return scores, solved[len(points):]


def _ensemble_search(
    spec: ModelSpec, rows: DataFrame, folds: list, tuning: TuningParams, refit: bool = True, facts: Mapping[int, Callable[[], tuple]] | None = None,
) -> tuple[list, dict[int, Any]]:
    """(scores as in cv_scores, the ensembles of all grid points on all rows), grown side by side."""
    shapes = _ensembles(spec.combinations())
    points = [(largest, sizes, fold) for largest, sizes in shapes for fold in folds]
    wanted = [(largest, (fold["train_from"], fold["train_to"])) for largest, _, fold in points]
    grown = _grow(spec, rows, wanted + [(largest, logistic.EVERYTHING) for largest, _ in shapes if refit], facts)
    whole = lambda sizes, e: {c: n or len(e.trees) for c, n in sizes.items()}
    scored = boosting.score_many(
        rows, [((fold["test_from"], fold["test_to"]), fold["fold"], e, whole(sizes, e)) for (_, sizes, fold), e in zip(points, grown)], ["target"])
    scores = [(r["combination"], r["fold"], r["score"]) for r in grouped_scores(scored, tuning.scoring, ("combination", "fold")).collect()]
    final = {c: e.first(n) for (_, sizes), e in zip(shapes, grown[len(points):]) for c, n in whole(sizes, e).items()}
    return scores, final


def tuning_table(spark, spec: ModelSpec, scores: list) -> DataFrame:
    """Mean, population deviation and rank of each grid point over the folds."""
    combos = spec.combinations()
    table = spark.createDataFrame(
        [(spec.name, c, json.dumps(combos[c]), f, s) for c, f, s in scores],
        "model string, combination int, params string, fold int, score double",
    )
    summary = table.groupBy("model", "combination", "params").agg(
        F.avg("score").alias("mean_test_score"), F.stddev_pop("score").alias("std_test_score"),
        F.count("*").alias("folds"),
    )
    order = Window.partitionBy("model").orderBy(F.col("mean_test_score").desc())
    return summary.withColumn("rank_test_score", F.rank().over(order))


def tune(spec: ModelSpec, train: DataFrame, folds: list, tuning: TuningParams) -> Tuned:
    """Grid search over past-only folds, then a refit on all training rows."""
    if not spec.grid:
        return Tuned(spec, fit(spec, {}, train), {})
    search, made = (_logistic_search, _solved) if spec.penalty else (_ensemble_search, _grown)
    scores, final = search(spec, train, folds, tuning)
    best, score = _best_point(scores)
    return Tuned(
        spec, made(train.sparkSession, final[best]), spec.combinations()[best], score,
        tuning_table(train.sparkSession, spec, scores),
    )


def _best_point(scores: list) -> tuple[int, float]:
    """(combination with the highest mean score over the folds, that mean); ties to the first."""
    means: dict[int, list[float]] = {}
    for c, _, s in scores:
        means.setdefault(c, []).append(s)
    best = max(sorted(means), key=lambda c: sum(means[c]) / len(means[c]))
    return best, sum(means[best]) / len(means[best])


def best_params(specs: list[ModelSpec], train: DataFrame, folds: list, tuning: TuningParams) -> list[dict[str, Any]]:
    """The parameters that `tune` picks for each model, for those who refit anyway: no tree is grown on all training rows.

    The searches of all models run at the same time.
    """
    searched = [s for s in specs if s.grid]
    facts = _tree_facts(searched, train, [(fold["train_from"], fold["train_to"]) for fold in folds])
    found = side_by_side(train.sparkSession, [partial(cv_scores, s, train, folds, tuning, facts) for s in searched])
    scores = dict(zip((s.name for s in searched), found, strict=True))
    return [s.combinations()[_best_point(scores[s.name])[0]] if s.grid else {} for s in specs]


def walk_forward_predictions(
    specs: list[tuple[ModelSpec, Mapping[str, Any]]], rows: DataFrame, folds: list,
    threshold: float = 0.5,
) -> DataFrame:
    """Refit each model with frozen parameters before every block and predict the block.

    The refits of all blocks move together, those of different families at the same time, and their models (and priors) score
    all blocks in one pass.
    """
    i = F.col("ordinal")
    spans = {fold["fold"]: (-(1 << 31), fold["train_to"]) for fold in folds}
    plain = [(spec, params) for spec, params in specs if not spec.ensemble]
    ensembles = [(spec, params) for spec, params in specs if spec.ensemble]
    points = [(spec, params, fold["fold"]) for spec, params in plain for fold in folds]
    fitted = [(spec, params, f) for spec, params, f in points if spec.penalty]
    facts = _tree_facts([spec for spec, _ in ensembles], rows, list(spans.values()))
    work = [partial(_grow, spec, rows, [(params, span) for span in spans.values()], facts) for spec, params in ensembles]
    if fitted:
        work.append(partial(logistic.fit_many, rows, [spec.job(p, spans[f]) for spec, p, f in fitted], max(s.most for s, _, _ in fitted)))
    if plain:
        work.append(partial(logistic.scalings, rows, list(spans.values())))
    results = side_by_side(rows.sparkSession, work)
    parts = []
    for (spec, _), grown in zip(ensembles, results):
        scored = boosting.score_many(rows, [((fold["test_from"], fold["test_to"]), fold["fold"], e, {0: len(e.trees)}) for fold, e in zip(folds, grown)],
                                     ["date", "ticker", "target", "fwd_ret"])
        p = F.col("prob_up")
        parts.append(scored.select(
            "date", "ticker", F.lit("walk_forward").alias("split"), F.lit(spec.name).alias("model"),
            F.when(F.abs(p - threshold) <= SNAP, F.lit(threshold)).otherwise(p).alias("prob_up"), "target", "fwd_ret", "fold"))
    if plain:
        solved = {(spec.name, f): s for (spec, _, f), s in zip(fitted, results[len(ensembles)] if fitted else [], strict=True)}
        facts = dict(zip(spans, results[-1], strict=True))
        table = []
        for spec, _, f in points:
            s = solved.get((spec.name, f))
            known = s is not None and s.coefficients is not None
            table.append((spec.name, f, [float(v) for v in s.coefficients] if known else None, float(s.intercept) if known else 0.0,
                          facts[f].ups / facts[f].rows if facts[f].rows else 0.0))
        place = F.lit(None).cast("int")
        for fold in folds:
            place = F.when((i >= fold["test_from"]) & (i < fold["test_to"]), fold["fold"]).otherwise(place)
        tested = rows.select("date", "ticker", "target", "fwd_ret", vector_to_array("features").alias("_x"), place.alias("fold")).where(F.col("fold").isNotNull())
        found = rows.sparkSession.createDataFrame(table, "model string, fold int, _b array<double>, _a double, _p double")
        p = logistic.probability("_x", "_b", "_a")
        snapped = F.when(F.abs(p - threshold) <= SNAP, F.lit(threshold)).otherwise(p)
        parts.append(tested.join(F.broadcast(found), "fold").select(  # one row per model and block
            "date", "ticker", F.lit("walk_forward").alias("split"), "model",
            F.when(F.col("_b").isNull(), F.col("_p")).otherwise(snapped).alias("prob_up"), "target", "fwd_ret", "fold"))

    return reduce(DataFrame.unionByName, parts)


def model_table(spark, tuned: list[Tuned], scoring: str = "neg_log_loss") -> DataFrame:
    """Grid size, chosen parameters, CV score and notes: one row per model."""
    return spark.createDataFrame(
        [
            (t.spec.name, t.spec.family, t.spec.estimator, len(t.spec.combinations()) if t.spec.grid else 0,
             json.dumps(t.best_params), t.cv_score, scoring, t.spec.note)
            for t in tuned
        ],
        "model string, family string, estimator string, grid_size int, best_params string, "
        "cv_score double, cv_scoring string, note string",
    )

