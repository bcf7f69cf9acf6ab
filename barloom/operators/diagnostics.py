"""Is a model a signal at all, and does it beat the passive benchmarks?"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import ratio
from barloom.operators import models
from barloom.operators.backtest import ALWAYS_LONG, BUY_AND_HOLD, signal
from barloom.operators.baseline import class_weights
from barloom.params import BacktestParams

# Tolerances for constant probabilities and identical returns.
CONSTANT_TOLERANCE = 1e-9
RETURN_TOLERANCE = 1e-12
RELATIVE_TOLERANCE = 1e-5
SIGNIFICANT_T = 2.0


def probability_profile(predictions: DataFrame, p: BacktestParams | None = None) -> DataFrame:
    """Range, spread, constancy and long share of each model's probabilities."""
    p = p or BacktestParams()
    prob = F.col("prob_up")
    tie = F.abs(prob - p.threshold) <= CONSTANT_TOLERANCE
    return predictions.groupBy("split", "model").agg(
        F.min(prob).alias("prob_min"), F.max(prob).alias("prob_max"),
        F.stddev_pop(prob).alias("prob_std"),
        (F.max(prob) - F.min(prob) <= CONSTANT_TOLERANCE).alias("constant_prediction"),
        F.avg((signal(prob, p) > 0).cast("double")).alias("long_fraction"),
        F.every(tie).alias("on_threshold_tie"),
    )


def active_returns(series: DataFrame) -> DataFrame:
    """Each strategy against always-long (identity) and buy-and-hold (mean, t-statistic).

    The two reference series are spread over the strategies of a date with one window, so
    there is no self-join; a date holds one row per strategy.
    """
    on_date = Window.partitionBy("split", "date")
    reference = lambda name: F.max(F.when(F.col("strategy") == name, F.col("net_ret"))).over(on_date)
    rows = series.select(
        "split", "strategy", "date", "net_ret",
        reference(ALWAYS_LONG).alias("_long"), reference(BUY_AND_HOLD).alias("_hold"),
    )
    close = F.abs(F.col("net_ret") - F.col("_long")) <= (
        RETURN_TOLERANCE + RELATIVE_TOLERANCE * F.abs("_long")
    )
    active = F.col("net_ret") - F.col("_hold")
    return rows.groupBy("split", "strategy").agg(
        F.every(F.coalesce(close, F.lit(False))).alias("identical_to_always_long"),
        F.avg(active).alias("active_vs_bh_mean_daily"),
        F.stddev_samp(active).alias("_std"), F.count(active).alias("_n"),
    ).withColumn(
        "active_vs_bh_tstat",
        F.when(F.col("_std") > 0,
               F.col("active_vs_bh_mean_daily") / F.col("_std") * F.sqrt("_n")),
    ).drop("_std", "_n")


def nonzero_coefficients(importance: DataFrame) -> DataFrame:
    """Coefficient counts per model from the long importance table."""
    raw = F.col("coef_raw_units")
    return importance.where(F.col("kind") == "coef").groupBy("model").agg(
        F.count("*").alias("n_coefficients"),
        F.count_if(F.abs(raw) > 0).alias("n_nonzero_coefficients"),
    )


def model_diagnostics(
    predictions: DataFrame, series: DataFrame, p: BacktestParams | None = None,
    coefficients: DataFrame | None = None, baseline: str = "majority",
) -> DataFrame:
    """One row per split and model; the baseline is constant by design, never degenerate."""
    active = active_returns(series).withColumnRenamed("strategy", "model")
    out = probability_profile(predictions, p).join(active, ["split", "model"], "left")
    zeroed = F.lit(False)
    if coefficients is not None:
        out = out.join(F.broadcast(nonzero_coefficients(coefficients)), "model", "left")
        zeroed = F.coalesce(F.col("n_nonzero_coefficients") == 0, F.lit(False))
    passive = (
        F.col("constant_prediction") | zeroed
        | F.coalesce(F.col("identical_to_always_long"), F.lit(False))
    )
    return out.withColumn("degenerate", (F.col("model") != baseline) & passive)


def _of(strategy: Column | str, value: str) -> Column:
    return F.max(F.when(F.col("strategy") == strategy, F.col(value)))


def benchmark_comparison(backtest: DataFrame, selected: str, benchmarks: list[str]) -> DataFrame:
    """The selected model's Sharpe, return and drawdown beside those of each benchmark.

    One pass: the selected figures are spread over a split's few strategies by a window.
    """
    whole = Window.partitionBy("split")
    shown = ("sharpe", "annualised_return", "max_drawdown")
    spread = [_of(selected, v).over(whole).alias(f"selected_{v}") for v in shown]
    return (
        backtest.select("split", "strategy", *shown, *spread)
        .where(F.col("strategy").isin(benchmarks))
        .withColumnRenamed("strategy", "benchmark")
    )


def lagged_row(sensitivity: DataFrame, cost_bps: float) -> DataFrame:
    """The one-day-lag row at the configured cost."""
    return sensitivity.where((F.col("execution_lag") == 1) & (F.col("cost_bps") == cost_bps))


def verdict(
    backtest: DataFrame, diagnostics: DataFrame, sensitivity: DataFrame, selected: str,
    cost_bps: float = 5.0, synthetic: bool = False,
) -> DataFrame:
    """What the test period says about the selected model, one row per split."""
    scores = backtest.groupBy("split").agg(
        _of(selected, "sharpe").alias("sharpe"),
        F.greatest(_of(BUY_AND_HOLD, "sharpe"), _of(ALWAYS_LONG, "sharpe")).alias("best_passive"),
    )
    about = diagnostics.where(F.col("model") == selected).select(
        "split", "degenerate", "active_vs_bh_tstat"
    )
    late = lagged_row(sensitivity, cost_bps).select("split", F.col("sharpe").alias("lag1_sharpe"))
    row = scores.join(about, "split").join(late, "split", "left")
    beats = (F.col("sharpe") > F.col("best_passive")) & (
        F.coalesce(F.col("lag1_sharpe") > F.col("best_passive"), F.lit(True))
    )
    significant = F.coalesce(F.col("active_vs_bh_tstat") > SIGNIFICANT_T, F.lit(False))
    return row.withColumn(
        "verdict",
        F.when(F.col("degenerate"), "degenerate")
        .when(beats & significant & F.lit(not synthetic), "beats_passive")
        .when(beats, "nominal_only")
        .otherwise("does_not_beat"),
    )


def best_live_model(
    classification: DataFrame, diagnostics: DataFrame, backtest: DataFrame,
    baseline: str = "majority", judged_on: str = "validation", split: str = "test",
) -> DataFrame:
    """Best model by validation log loss that is not degenerate on test, and its verdict."""
    dead = diagnostics.where((F.col("split") == split) & F.col("degenerate")).select("model")
    live = classification.where(
        (F.col("split") == judged_on) & (F.col("model") != baseline)
    ).join(dead, "model", "left_anti")
    order = Window.partitionBy("split").orderBy(F.col("log_loss").asc_nulls_last(), "model")
    best = live.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(
        "model", F.col("log_loss").alias("validation_log_loss")
    )
    whole = Window.partitionBy("split")
    rated = backtest.where(F.col("split") == split).select(
        F.col("strategy").alias("model"), "sharpe",
        F.greatest(
            _of(BUY_AND_HOLD, "sharpe").over(whole), _of(ALWAYS_LONG, "sharpe").over(whole)
        ).alias("best_passive"),
    )
    tests = diagnostics.where(F.col("split") == split).select(
        "model", "active_vs_bh_tstat", "long_fraction"
    )
    auc = classification.where(F.col("split") == split).select("model", "roc_auc")
    wins = (F.col("sharpe") > F.col("best_passive")) & F.coalesce(
        F.col("active_vs_bh_tstat") > SIGNIFICANT_T, F.lit(False)
    )
    return best.join(rated, "model").join(tests, "model").join(auc, "model").withColumn(
        "beats_passive", wins
    )


def last_data_date(bars: DataFrame) -> DataFrame:
    """The most recent bar of the universe, and of each end of it."""
    per_ticker = bars.groupBy("ticker").agg(F.max("date").alias("last"))
    return per_ticker.agg(
        F.max("last").alias("last_date"), F.min("last").alias("earliest_last_date"),
        F.count("*").alias("tickers"),
    )


def stationarity(fitted: models.Fitted, spec: models.ModelSpec, params: dict, rows: DataFrame, features: list[str]) -> DataFrame:
    """(model, feature, score_moment, label_moment): first-order conditions of a logistic model on the rows it was fitted on.

    label_moment is the weighted mean of label times scaled feature, a fact of the data. score_moment is that of the
    probability plus what the penalty gives: strength times the coefficient (L2), strength times its sign, or for a coefficient of zero what
    is missing, up to the strength (L1). The two are equal for every feature and the intercept if and only if the model is optimal.
    """
    last = fitted.model.stages[-1]
    strength = 0.0 if spec.penalty == "none" else 1.0 / (float(params.get("C", 1.0)) * fitted.rows)
    weights = F.broadcast(class_weights(rows).select("target", "weight"))  # two rows
    scored = models.with_probability(fitted, rows.join(weights, "target") if spec.balanced else rows.withColumn("weight", F.lit(1.0)))
    x, p, y = vector_to_array("features"), F.col("weight") * F.col("prob_up"), F.col("weight") * F.col("target")
    wide = scored.select(p.alias("_p"), y.alias("_y"), *(x[j].alias(f"_{j}") for j in range(len(features))))
    table = [F.struct(
        F.lit(f).alias("feature"), F.lit(float(last.coefficients[j])).alias("raw"), F.stddev_pop(f"_{j}").alias("sd"), F.avg(f"_{j}").alias("mean"),
        F.avg(F.col("_p") * F.col(f"_{j}")).alias("px"), F.avg(F.col("_y") * F.col(f"_{j}")).alias("yx"), F.avg("_p").alias("p"), F.avg("_y").alias("y"))
        for j, f in enumerate(features)]
    flat = wide.agg(F.array(*table).alias("_t")).select(F.inline("_t"))
    moment = lambda product, share: (F.col(product) - F.col("mean") * F.col(share)) / F.col("sd")
    score, label, b = moment("px", "p"), moment("yx", "y"), F.col("raw") * F.col("sd")
    extra = {
        "none": F.lit(0.0), "l2": strength * b,
        "l1": F.when(b != 0, strength * F.signum(b)).otherwise(F.greatest(F.lit(-strength), F.least(F.lit(strength), label - score))),
    }[spec.penalty]
    conditions = flat.where("sd > 0").select("feature", (score + extra).alias("score_moment"), label.alias("label_moment"))
    intercept = wide.agg(F.lit("(intercept)").alias("feature"), F.avg("_p").alias("score_moment"), F.avg("_y").alias("label_moment"))
    return conditions.unionByName(intercept).select(F.lit(spec.name).alias("model"), "feature", "score_moment", "label_moment")
