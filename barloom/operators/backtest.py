"""Daily long/cash (or long/short) backtest of many strategies in one relation.

Rows are (split, strategy, date, ticker). A strategy's ticker has one row per date, so
every window below has the calendar as its bound. All strategies, lags and costs share
the same three shuffles: by ticker, by date, by strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import guard, ratio
from barloom.functions.windows import running
from barloom.params import BacktestParams

KEYS = ("split", "strategy")
ALWAYS_LONG = "always_long"
BUY_AND_HOLD = "buy_and_hold"
# The cost and lag grid of the sensitivity table.
SENSITIVITY_LAGS = (0, 1)
SENSITIVITY_COSTS = (0.0, 2.0, 5.0, 10.0, 20.0)


def signal(prob: Column, p: BacktestParams | None = None) -> Column:
    """Position wanted at the close: long at or above the threshold, short below its own."""
    p = p or BacktestParams()
    out = F.when(prob >= p.threshold, 1.0)
    if p.long_short:
        out = out.when(prob < p.short_threshold, -1.0)
    return out.otherwise(0.0)


def model_signals(predictions: DataFrame, p: BacktestParams | None = None) -> DataFrame:
    return predictions.select(
        "split", F.col("model").alias("strategy"), F.lit("model").alias("kind"),
        "date", "ticker", "fwd_ret", signal(F.col("prob_up"), p).alias("signal"),
    )


def benchmark_frame(
    predictions: DataFrame, panel: DataFrame, key_model: str, p: BacktestParams | None = None
) -> DataFrame:
    """One model's (split, date, ticker, fwd_ret) with the trend column of the panel."""
    p = p or BacktestParams()
    column = f"dist_ma_{p.ma_rule_window}"
    if column not in panel.columns:
        raise ValueError(f"the moving-average rule needs the panel column {column}")
    rows = predictions.where(F.col("model") == key_model).select("split", "date", "ticker", "fwd_ret")
    return rows.join(panel.select("date", "ticker", column), ["date", "ticker"], "left")


def benchmark_signals(frame: DataFrame, p: BacktestParams | None = None) -> DataFrame:
    """Rule benchmarks: hold every ticker, and hold it only above its moving average."""
    p = p or BacktestParams()
    trend = F.coalesce(F.col(f"dist_ma_{p.ma_rule_window}") > 0, F.lit(False)).cast("double")
    rules = F.array(
        F.struct(F.lit(ALWAYS_LONG).alias("strategy"), F.lit(1.0).alias("signal")),
        F.struct(F.lit(p.ma_rule()).alias("strategy"), trend.alias("signal")),
    )
    return frame.select("split", "date", "ticker", "fwd_ret", F.inline(rules)).select(
        "split", "strategy", F.lit("benchmark").alias("kind"), "date", "ticker", "fwd_ret", "signal"
    )


def positions(
    frame: DataFrame, cost_bps: float = 5.0, execution_lag: int = 0, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Daily position, turnover, cost and return per key and ticker.

    Signals act `execution_lag` rows later, starting from cash; the first entry is charged,
    a final exit is not. A repeated (key, date, ticker) fails when evaluated.
    """
    missing = {"date", "ticker", "fwd_ret", "signal"} - set(frame.columns)
    if missing:
        raise ValueError(f"positions need the columns {sorted(missing)}")
    w = Window.partitionBy(*keys, "ticker").orderBy("date")
    wanted = F.col("signal").cast("double")
    position = F.coalesce(F.lag(wanted, execution_lag).over(w), F.lit(0.0)) if execution_lag else wanted
    # The previous position is the signal one row further back, so one window is enough.
    before = F.coalesce(F.lag(wanted, execution_lag + 1).over(w), F.lit(0.0))
    staged = frame.select(
        *keys, "date", "ticker", "fwd_ret",
        position.alias("position"), before.alias("_before"), F.lag("date").over(w).alias("_prior"),
    )
    repeated = F.col("_prior") == F.col("date")
    turnover = F.abs(F.col("position") - F.col("_before"))
    return (
        staged.withColumn("turnover", guard(
            F.coalesce(repeated, F.lit(False)), "duplicate (date, ticker) rows in a backtest", turnover, "double"))
        .withColumn("gross_ret", F.col("position") * F.col("fwd_ret"))
        .withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
        .withColumn("net_ret", F.col("gross_ret") - F.col("cost"))
        .drop("_before", "_prior")
    )


def trade_list(pos: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per trade: a maximal run of one non-zero position.

    The row after the run pays for the change; the closing trade bears the share
    |old| / |new - old| of it, and nothing when the data end first.
    """
    w = Window.partitionBy(*keys, "ticker").orderBy("date")
    position, following = F.col("position"), F.col("_next_position")
    staged = pos.select(
        *keys, "ticker", "date", "position", "net_ret",
        F.lag("position").over(w).alias("_previous"),
        F.lead("position").over(w).alias("_next_position"),
        F.lead("cost").over(w).alias("_next_cost"),
    )
    starts = F.coalesce(F.col("_previous") != position, F.lit(True)).cast("int")
    exit_cost = F.when(
        following != position,
        F.col("_next_cost") * F.abs(position) / F.abs(following - position),
    )
    runs = staged.select(
        *keys, "ticker", "date", "position", "net_ret",
        starts.alias("_starts"), exit_cost.alias("_exit"),
    ).withColumn("trade", F.sum("_starts").over(running(w))).where(position != 0)
    return (
        runs.groupBy(*keys, "ticker", "trade")
        .agg(
            F.first("position").alias("position"),
            F.min("date").alias("entry"), F.max("date").alias("last_day"),
            F.count("*").alias("days"),
            F.product(1.0 + F.col("net_ret")).alias("_growth"), F.max("_exit").alias("_exit"),
        )
        .select(
            *keys, "ticker", "position", "entry", "last_day", "days",
            (F.col("_growth") * (1.0 - F.coalesce("_exit", F.lit(0.0))) - 1.0).alias("trade_return"),
        )
    )


def portfolio(pos: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Equal weight over the tickers present each date (an absent ticker is not cash)."""
    return pos.groupBy(*keys, "date").agg(
        *(F.avg(c).alias(c) for c in ("net_ret", "gross_ret", "cost", "turnover")),
        F.avg(F.abs("position")).alias("exposure"),
        F.count_if(F.col("turnover") > 0).alias("changes"),
    )


def buy_and_hold(frame: DataFrame, cost_bps: float = 5.0, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """Equal starting weights left to drift; an absent ticker earns nothing that day.

    A dense dates x tickers grid is not needed: a ticker's growth only moves on its own
    rows, so the portfolio value is 1 plus the running sum of those moves over tickers.
    """
    by_ticker = Window.partitionBy(*keys, "ticker").orderBy("date")
    growth = F.product(1.0 + F.coalesce("fwd_ret", F.lit(0.0))).over(running(by_ticker))
    moves = frame.select(*keys, "ticker", "date", growth.alias("_growth")).withColumn(
        "_move", F.col("_growth") - F.coalesce(F.lag("_growth").over(by_ticker), F.lit(1.0))
    )
    daily = moves.groupBy(*keys, "date").agg(F.sum("_move").alias("_move"))
    sleeves = frame.groupBy(*keys, "ticker").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        F.count("*").alias("_tickers")
    )
    by_date = Window.partitionBy(*keys).orderBy("date")
    value = 1.0 + F.sum("_move").over(running(by_date)) / F.col("_tickers")
    valued = daily.join(F.broadcast(sleeves), list(keys)).select(
        *keys, "date", "_tickers", value.alias("_value")
    )
    start = F.lag("_value").over(by_date)
    entry = F.when(start.isNull(), 1.0).otherwise(0.0)
    return (
        valued.select(
            *keys, "date",
            (F.col("_value") / F.coalesce(start, F.lit(1.0)) - 1.0).alias("gross_ret"),
            entry.alias("turnover"), F.col("_tickers").alias("tickers"),
        )
        .withColumn("cost", F.col("turnover") * (cost_bps / 1e4))
        .withColumn("net_ret", F.col("gross_ret") - F.col("cost"))
        .withColumn("exposure", F.lit(1.0))
        .withColumn("changes", (F.col("turnover") > 0).cast("long"))
    )


def risk_metrics(
    series: DataFrame, keys: tuple[str, ...] = KEYS,
    risk_free_rate: float = 0.0, periods_per_year: int = 252,
) -> DataFrame:
    """Summary statistics of daily series (net_ret, turnover, cost, exposure, changes)."""
    w = Window.partitionBy(*keys).orderBy("date")
    net = F.coalesce("net_ret", F.lit(0.0))
    curve = series.select(
        *keys, "date", net.alias("net_ret"), "turnover", "cost", "exposure", "changes",
        F.product(1.0 + net).over(running(w)).alias("_equity"),
    )
    peak = F.greatest(F.lit(1.0), F.max("_equity").over(running(w)))
    curve = curve.withColumn("_fall", F.col("_equity") / peak - 1.0)
    per = float(periods_per_year)
    daily_rf = (1.0 + risk_free_rate) ** (1.0 / per) - 1.0
    excess = F.col("net_ret") - daily_rf
    in_market = F.col("exposure") > 0
    s = curve.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.max_by("_equity", "date").alias("_final"),
        F.stddev_samp("net_ret").alias("_std"),
        F.avg(excess).alias("_mean"), F.stddev_samp(excess).alias("_estd"),
        F.least(F.lit(0.0), F.min("_fall")).alias("max_drawdown"),
        F.avg(F.when(in_market, (F.col("net_ret") > 0).cast("double"))).alias("hit_rate"),
        F.count_if(F.col("turnover") > 0).alias("turnover_days"),
        F.sum("changes").alias("n_position_changes"),
        (F.avg("turnover") * per).alias("annual_turnover"),
        F.avg("exposure").alias("avg_exposure"),
        F.sum("cost").alias("total_cost"),
    )
    years = F.col("days") / F.lit(per)
    s = s.withColumn("years", years).withColumn(
        "annualised_return",
        F.when(F.col("_final") > 0, F.pow("_final", 1.0 / F.col("years")) - 1.0).otherwise(-1.0),
    ).withColumn("sharpe", F.when(F.col("_estd") > 0, F.col("_mean") / F.col("_estd") * per**0.5))
    return s.select(
        *keys, "days", "years",
        (F.col("_final") - 1.0).alias("cumulative_return"),
        "annualised_return",
        (F.col("_std") * per**0.5).alias("annualised_volatility"),
        "sharpe", (F.col("sharpe") * F.sqrt("years")).alias("sharpe_tstat"),
        "max_drawdown",
        F.when((F.col("years") >= 1) & (F.col("max_drawdown") < 0),
               F.col("annualised_return") / F.abs("max_drawdown")).alias("calmar"),
        "hit_rate", "turnover_days", "n_position_changes",
        "annual_turnover", "avg_exposure", "total_cost",
    )


def trade_summary(trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return trades.groupBy(*keys).agg(
        F.avg("trade_return").alias("avg_trade_return"), F.count("*").alias("n_trades")
    )


def with_trades(risk: DataFrame, trades: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Add the trade statistics; a strategy that never traded has zero trades."""
    joined = risk.join(trade_summary(trades, keys), list(keys), "left")
    return joined.withColumn("n_trades", F.coalesce("n_trades", F.lit(0))).drop("turnover_days")


def daily_series(
    strategies: DataFrame, frame: DataFrame, p: BacktestParams | None = None
) -> DataFrame:
    """Daily portfolio of every rule and model plus buy-and-hold, as one long table."""
    p = p or BacktestParams()
    port = portfolio(positions(strategies, p.cost_bps, p.execution_lag))
    held = buy_and_hold(frame, p.cost_bps).withColumn("strategy", F.lit(BUY_AND_HOLD))
    return port.unionByName(held.select(*port.columns))


def backtest_table(
    predictions: DataFrame, panel: DataFrame, key_model: str, p: BacktestParams | None = None
) -> DataFrame:
    """Risk table of every model and benchmark in every split."""
    p = p or BacktestParams()
    frame = benchmark_frame(predictions, panel, key_model, p)
    strategies = model_signals(predictions, p).unionByName(benchmark_signals(frame, p))
    pos = positions(strategies, p.cost_bps, p.execution_lag)
    rated = with_trades(
        risk_metrics(portfolio(pos), KEYS, p.risk_free_rate, p.periods_per_year), trade_list(pos)
    )
    held = buy_and_hold(frame, p.cost_bps).withColumn("strategy", F.lit(BUY_AND_HOLD))
    sleeves = held.groupBy(*KEYS).agg(F.max("tickers").alias("n_trades"))
    passive = (
        risk_metrics(held, KEYS, p.risk_free_rate, p.periods_per_year)
        .join(sleeves, list(KEYS)).drop("turnover_days")
        .withColumn("avg_trade_return", F.lit(None).cast("double"))
    )
    kind = F.when(
        F.col("strategy").isin(ALWAYS_LONG, p.ma_rule(), BUY_AND_HOLD), "benchmark"
    ).otherwise("model")
    return rated.unionByName(passive.select(*rated.columns)).withColumn("kind", kind)


def wide_returns(series: DataFrame, strategies: list[str]) -> DataFrame:
    """One net-return column per strategy, one row per split and date."""
    return series.groupBy("split", "date").pivot("strategy", strategies).agg(F.first("net_ret"))


def sensitivity_table(
    predictions: DataFrame, model: str, p: BacktestParams | None = None
) -> DataFrame:
    """One model's backtest over the fixed grid of execution lags and costs.

    Gross return and turnover of both lags come from one window pass. Costs are linear in
    turnover, so the grid is laid over the daily averages, not over the ticker rows.
    """
    p = p or BacktestParams()
    frame = model_signals(predictions.where(F.col("model") == model), p)
    w = Window.partitionBy("split", "ticker").orderBy("date")
    back = lambda k: F.coalesce(F.lag("signal", k).over(w), F.lit(0.0))
    depth = max(SENSITIVITY_LAGS) + 1
    staged = frame.select(
        "split", "date", "fwd_ret", F.col("signal").alias("_s0"),
        *(back(k).alias(f"_s{k}") for k in range(1, depth + 1)),
    )
    sums = []
    for lag in SENSITIVITY_LAGS:
        position, before = F.col(f"_s{lag}"), F.col(f"_s{lag + 1}")
        sums += [
            F.avg(position * F.col("fwd_ret")).alias(f"_g{lag}"),
            F.avg(F.abs(position - before)).alias(f"_t{lag}"),
            F.avg(F.abs(position)).alias(f"_e{lag}"),
        ]
    daily = staged.groupBy("split", "date").agg(*sums)
    grid = F.array(*(
        F.struct(
            F.lit(lag).alias("execution_lag"), F.lit(bps).alias("cost_bps"),
            F.col(f"_g{lag}").alias("gross_ret"), F.col(f"_t{lag}").alias("turnover"),
            F.col(f"_e{lag}").alias("exposure"), (F.col(f"_t{lag}") * (bps / 1e4)).alias("cost"),
        )
        for lag in SENSITIVITY_LAGS for bps in SENSITIVITY_COSTS
    ))
    series = daily.select("split", "date", F.inline(grid)).withColumn(
        "net_ret", F.col("gross_ret") - F.col("cost")
    ).withColumn("changes", (F.col("turnover") > 0).cast("long"))
    keys = ("split", "execution_lag", "cost_bps")
    return risk_metrics(series, keys, p.risk_free_rate, p.periods_per_year).select(
        *keys, "annualised_return", "sharpe", "max_drawdown", "annual_turnover", "total_cost"
    )


def per_ticker_table(
    predictions: DataFrame, model: str, p: BacktestParams | None = None
) -> DataFrame:
    """One model against simply holding, ticker by ticker (always 252 days a year).

    Exposure is the signed position here, so short days do not count as invested.
    """
    p = p or BacktestParams()
    rows = predictions.where(F.col("model") == model)
    sides = F.array(
        F.struct(F.lit(model).alias("strategy"), signal(F.col("prob_up"), p).alias("signal")),
        F.struct(F.lit("hold_ticker").alias("strategy"), F.lit(1.0).alias("signal")),
    )
    frame = rows.select("split", "date", "ticker", "fwd_ret", F.inline(sides))
    pos = positions(frame, p.cost_bps, p.execution_lag)
    series = pos.withColumn("exposure", F.col("position")).withColumn(
        "changes", (F.col("turnover") > 0).cast("long")
    )
    keys = ("split", "ticker", "strategy")
    rated = with_trades(
        risk_metrics(series, keys, p.risk_free_rate), trade_list(pos), keys
    )
    return rated.select(
        *keys, "annualised_return", "annualised_volatility", "sharpe", "max_drawdown",
        "hit_rate", "n_trades",
    )
