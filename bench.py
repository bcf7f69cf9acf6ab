"""Time the headline queries and print one JSON line.

Input folder from BENCH_SF_DIR, cores from BENCH_CPUS. Instruments are brand x type (150
tickers). Bars, panel and predictions are written once, as in a real run; each timed step
reads the table the step before it wrote and is forced through a full evaluation.
"""

import json
import os
import sys
import time

from barloom.operators import (
    backtest, baseline, cleaning, diagnostics, explore, metrics, models, panel, series, splits,
)
from barloom.params import DataParams, ResearchParams
from barloom.sources import bars as bar_files
from barloom.sources import tpch
from barloom.sources.session import local_session, shared_folder

MARKET = "BRAND#11 STANDARD"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    params = ResearchParams(data=DataParams(market_ticker=MARKET))
    bt, out, timings = params.backtest, shared_folder(spark), {}

    def timed(name, make):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)

    def stored(name, make):
        start = time.perf_counter()
        make().write.parquet(f"{out}/{name}")
        timings[name] = round(time.perf_counter() - start, 3)
        return spark.read.parquet(f"{out}/{name}")

    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    start = time.perf_counter()
    bar_files.write_bars(tpch.daily_bars(spark, sf_dir, tpch.by_brand_and_type()), f"{out}/bars")
    timings["daily_bars"] = round(time.perf_counter() - start, 3)
    bars = bar_files.read_bars(spark, f"{out}/bars")
    # Ingest as a run does it: CSV files of many headers, then candidates written once for report and bars.
    raw = tpch.vendor_rows(spark, sf_dir).repartition("ticker").sortWithinPartitions("ticker", "_seq").drop("_seq")
    raw.write.option("header", True).partitionBy("ticker").csv(f"{out}/vendor")
    timed("vendor_csv_clean", lambda: cleaning.clean_bars(cleaning.daily_candidates(bar_files.read_vendor_csv(spark, f"{out}/vendor"))))
    candidates = stored("daily_candidates", lambda: cleaning.daily_candidates(tpch.vendor_rows(spark, sf_dir)))
    timed("cleaning_report", lambda: cleaning.cleaning_report(candidates))
    timed("clean_bars", lambda: cleaning.clean_bars(candidates))
    rows = stored("feature_panel", lambda: panel.build_panel(bars, params))
    timed("feature_panel_in_blocks", lambda: panel.build_panel(bars, params, block_rows=512))
    timed("panel_profile", lambda: panel.panel_profile(rows))
    tagged = stored("chronological_split", lambda: splits.chronological_split(rows, params))
    axis = splits.date_axis(rows)
    timed("walk_forward_folds", lambda: splits.fold_table(splits.walk_forward_folds(axis, 756, 252, 1), axis))
    vectors = models.assemble(tagged)
    spec = models.model_specs(params)["logreg_l2"]
    timed("logistic_fit_predict", lambda: models.predictions(
        spec, models.fit(spec, {"C": 0.1}, vectors.where("split = 'train'")), vectors.where("split = 'test'"), "test"))
    timed("fold_class_weights", lambda: baseline.fold_class_weights(rows, axis, splits.cv_folds(axis, 4, 1)))
    preds = stored("score_predictions", lambda: baseline.score_predictions(tagged).unionByName(
        baseline.majority_predictions(tagged)))
    timed("classification_table", lambda: metrics.classification_table(preds))
    frame = backtest.benchmark_frame(preds, rows, "majority", bt)
    strategies = backtest.model_signals(preds, bt).unionByName(backtest.benchmark_signals(frame, bt))
    daily = stored("daily_series", lambda: backtest.daily_series(strategies, frame, bt))
    timed("backtest_table", lambda: backtest.backtest_table(preds, rows, "majority", bt))
    timed("trade_list", lambda: backtest.trade_list(backtest.positions(strategies, bt.cost_bps)))
    timed("sensitivity_table", lambda: backtest.sensitivity_table(preds, "momentum", bt))
    timed("per_ticker_table", lambda: backtest.per_ticker_table(preds, "momentum", bt))
    timed("model_diagnostics", lambda: diagnostics.model_diagnostics(preds, daily, bt))
    timed("equity_curves", lambda: series.equity_curves(daily))
    timed("roc_points", lambda: series.roc_points(preds))
    timed("calibration_curve", lambda: series.calibration_curve(preds))
    timed("rank_correlation", lambda: explore.rank_correlation(rows))
    timed("correlation_matrix", lambda: explore.correlation_matrix(rows))
    spark.stop()
    print(json.dumps({
        "metric": "headline panel queries, wall time", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    sys.exit(main())
