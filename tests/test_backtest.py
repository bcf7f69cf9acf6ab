import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from barloom.operators import backtest as B
from barloom.operators import diagnostics as D
from barloom.params import BacktestParams


@pytest.fixture
def frame(one_ticker):
    def make(signal, fwd, ticker="A"):
        df = one_ticker(ticker, signal=signal, fwd_ret=fwd)
        return df.withColumn("split", F.lit("test")).withColumn("strategy", F.lit("s"))
    return make


def random_signals(seed, n=40):
    rng = np.random.default_rng(seed)
    return list(rng.choice([-1.0, 0.0, 0.5, 1.0], n)), list(rng.normal(0, 0.03, n))


@pytest.mark.parametrize("lag", [0, 1, 3])
def test_positions_follow_their_identities(frame, lag):
    signal, fwd = random_signals(lag)
    rows = B.positions(frame(signal, fwd), 25.0, lag).orderBy("date").collect()
    held = [0.0] * lag + signal[:len(signal) - lag]
    assert [r.position for r in rows] == held
    assert np.allclose([r.turnover for r in rows], np.abs(np.diff([0.0, *held])))
    assert np.allclose([r.cost for r in rows], [r.turnover * 25e-4 for r in rows])
    assert np.allclose([r.net_ret for r in rows], [h * f - r.cost for h, f, r in zip(held, fwd, rows, strict=True)])


def test_costs_scale_and_vanish(frame):
    signal, fwd = random_signals(7)
    free, cheap, dear = (B.positions(frame(signal, fwd), c) for c in (0.0, 4.0, 8.0))
    assert column(free, "net_ret") == column(free, "gross_ret") == column(dear, "gross_ret")
    assert np.allclose(2 * np.array(column(cheap, "cost")), column(dear, "cost"))


def test_signal_thresholds_are_inclusive(spark):
    p = spark.createDataFrame([(x / 20,) for x in range(21)], "p double")
    rules = BacktestParams(threshold=0.6)
    got = [r[0] for r in p.select(B.signal(F.col("p"), rules)).collect()]
    assert got == [0.0] * 12 + [1.0] * 9
    both = BacktestParams(long_short=True, threshold=0.6, short_threshold=0.35)
    assert [r[0] for r in p.select(B.signal(F.col("p"), both)).collect()] == [-1.0] * 7 + [0.0] * 5 + [1.0] * 9


def test_later_signals_leave_earlier_rows_alone(frame):
    signal, fwd = random_signals(3)
    other = signal[:25] + [1.0 - x for x in signal[25:]]
    a, b = (B.positions(frame(s, fwd), 5.0).orderBy("date").take(25) for s in (signal, other))
    assert a == b


def test_portfolio_is_the_plain_mean_of_its_tickers(frame):
    parts = [B.positions(frame(*random_signals(seed), ticker), 12.0) for seed, ticker in ((1, "P"), (2, "Q"), (3, "R"))]
    port = B.portfolio(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    for name in ("net_ret", "gross_ret", "cost", "turnover"):
        assert np.allclose(column(port, name), np.mean([column(p, name) for p in parts], axis=0))


def test_duplicate_rows_fail(frame):
    rows = frame([1, 1], [0.1, 0.1])
    with pytest.raises(Exception, match="duplicate"):
        B.positions(rows.unionByName(rows)).collect()
    with pytest.raises(ValueError):
        B.positions(rows.drop("signal"))


def test_free_trades_multiply_to_the_growth_of_their_ticker(frame):
    signal, fwd = random_signals(11, 200)
    pos = B.positions(frame(signal, fwd), 0.0)
    trades = B.trade_list(pos)
    assert np.prod(1 + np.array(column(trades, "trade_return", "entry"))) == pytest.approx(np.prod(1 + np.array(column(pos, "net_ret"))))
    assert trades.agg(F.sum("days")).first()[0] == sum(x != 0 for x in signal)


def test_a_single_trade_pays_on_both_ends(frame):
    one = B.trade_list(B.positions(frame([0, 1, 1, 1, 0], [0.3, 0.02, -0.01, 0.04, 0.5]), 30.0)).collect()
    assert len(one) == 1 and one[0].days == 3
    assert one[0].trade_return == pytest.approx((1.02 - 0.003) * 0.99 * 1.04 * (1 - 0.003) - 1)
    open_end = B.trade_list(B.positions(frame([0, 0, 1], [0.1, 0.1, 0.05]), 30.0)).collect()
    assert open_end[0].trade_return == pytest.approx(0.05 - 0.003)


def test_buy_and_hold_is_the_mean_of_its_growth_paths(frame):
    rng = np.random.default_rng(8)
    returns = {t: rng.normal(0, 0.02, 30) for t in "KLM"}
    rows = None
    for t, r in returns.items():
        part = frame([1] * 30, list(r), t)
        rows = part if rows is None else rows.unionByName(part)
    value = np.mean([np.cumprod(1 + r) for r in returns.values()], axis=0)
    assert np.allclose(column(B.buy_and_hold(rows, 0.0), "net_ret"), value / np.r_[1, value[:-1]] - 1)
    cost = column(B.buy_and_hold(rows, 40.0), "cost")
    assert cost[0] == pytest.approx(40e-4) and sum(cost[1:]) == 0


def test_buy_and_hold_treats_absence_as_flat(frame):
    a, b = frame([1] * 4, [0.1, 0.1, 0.1, 0.1], "A"), frame([1] * 4, [0.2, 0.2, 0.2, 0.2], "B")
    some = a.unionByName(b.where(F.dayofmonth("date").isin(2, 4)))
    value = [(1.1 + 1) / 2, (1.21 + 1.2) / 2, (1.331 + 1.2) / 2, (1.4641 + 1.44) / 2]
    expected = [value[0] - 1, *(value[k] / value[k - 1] - 1 for k in range(1, 4))]
    assert np.allclose(column(B.buy_and_hold(some, 0.0), "gross_ret"), expected)


def test_risk_metrics_of_a_random_series(one_ticker):
    n = 300
    r = np.random.default_rng(12).normal(0.001, 0.02, n)
    r[::10] = 0.0
    series = one_ticker(net_ret=r, turnover=[0.1] * n, cost=[0.0] * n, exposure=[1.0] * n).withColumn("changes", F.lit(0))
    m = B.risk_metrics(series, ("ticker",)).first()
    worth = np.cumprod(1 + r)
    assert m.days == n and m.cumulative_return == pytest.approx(worth[-1] - 1)
    assert m.annualised_return == pytest.approx(worth[-1] ** (252 / n) - 1)
    assert m.sharpe == pytest.approx(np.sqrt(252) * r.mean() / r.std(ddof=1))
    deepest = min(worth[k] / max(1.0, worth[:k + 1].max()) - 1 for k in range(n))
    assert m.max_drawdown == pytest.approx(deepest) and m.calmar == pytest.approx(m.annualised_return / -deepest)
    assert B.risk_metrics(series, ("ticker",), 0.1).first().sharpe < m.sharpe
    lost = one_ticker(net_ret=[-0.5], turnover=[1.0], cost=[0.0], exposure=[0.0]).withColumn("changes", F.lit(1))
    one = B.risk_metrics(lost, ("ticker",)).first()
    assert one.sharpe is None and one.calmar is None and one.hit_rate is None and one.max_drawdown == -0.5


def test_benchmark_rules(frame):
    rows = frame([0] * 5, [0.0] * 5).drop("strategy", "signal")
    distance = [-0.3, 1e-9, 0.0, 0.2, -1e-9]
    trend = rows.withColumn("dist_ma_50", F.get(F.array(*map(F.lit, distance)), F.dayofmonth("date") - 1))
    out = B.benchmark_signals(trend)
    assert column(out.where("strategy = 'ma_rule_50d'"), "signal") == [float(d > 0) for d in distance]
    assert set(column(out.where("strategy = 'always_long'"), "signal")) == {1.0}
    with pytest.raises(ValueError):
        B.benchmark_frame(rows, rows, "m", BacktestParams(ma_rule_window=20))


def test_models_that_never_decide_are_flagged(spark, frame):
    n, rng = 36, np.random.default_rng(21)
    base = frame(list(rng.beta(2, 2, n)), list(rng.normal(0.002, 0.02, n))).withColumnRenamed("signal", "draw").drop("strategy")
    shapes = {"flat_high": F.lit(0.8), "flat_low": F.lit(0.1), "on_the_line": F.lit(0.5), "mixed": F.col("draw"), "majority": F.lit(0.52)}
    preds = base.select("split", "date", "ticker", "fwd_ret", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), p.alias("prob_up")) for m, p in shapes.items()))))
    free = BacktestParams(cost_bps=0.0)
    held = B.benchmark_frame(preds, base.select("date", "ticker", F.lit(-1.0).alias("dist_ma_50")), "majority", free)
    strategies = B.model_signals(preds, free).unionByName(B.benchmark_signals(held, free))
    coefs = spark.createDataFrame([("coef", "mixed", f"x{k}", c) for k, c in enumerate((0.2, 0.0, -1.5))], "kind string, model string, feature string, coef_raw_units double")
    rows = {r.model: r for r in D.model_diagnostics(preds, B.daily_series(strategies, held, free), free, coefs).collect()}
    assert {m for m, r in rows.items() if r.constant_prediction} == set(shapes) - {"mixed"}
    assert {m for m, r in rows.items() if r.on_threshold_tie} == {"on_the_line"}
    assert {m for m, r in rows.items() if r.identical_to_always_long} == {"flat_high", "on_the_line", "majority"}
    assert not rows["mixed"].degenerate and not rows["majority"].degenerate and rows["flat_high"].degenerate
    assert rows["mixed"].n_nonzero_coefficients == 2 and rows["flat_low"].long_fraction == 0
