"""Rank correlations and the correlation matrix against plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barloom.operators import explore


def frame(spark, columns):
    n = len(columns["fwd_ret"])
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), *(None if v is None or v != v else (v if isinstance(v, str) else float(v)) for v in (c[k] for c in columns.values()))) for k in range(n)]
    types = ", ".join(f"{c} {'string' if c == 'ticker' else 'double'}" for c in columns)
    return spark.createDataFrame(rows, f"date date, {types}").repartition(6)


def ranked(columns):
    df, out = pd.DataFrame(columns), {}
    for t, g in df.groupby("ticker"):
        for c in [c for c in df.columns if c not in ("ticker", "fwd_ret")]:
            x, y = g[c].rank(), g["fwd_ret"].rank()
            out[t, c] = float(np.corrcoef(x, y)[0, 1]) if x.nunique() > 1 and y.nunique() > 1 else None
    return out


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_rank_correlation_of_a_hot_ticker_with_ties(spark, blocks):
    r = np.random.default_rng(1)
    sizes = {"HOT": 900, "SMALL": 12, "ONE": 1, "FLAT": 30}
    ticker = [t for t, n in sizes.items() for _ in range(n)]
    n = len(ticker)
    y = np.round(r.normal(size=n), 2)
    columns = {
        "ticker": ticker, "fwd_ret": y, "smooth": y + r.normal(size=n), "tied": np.round(r.normal(size=n)), "same": np.ones(n),
        "shifted": r.normal(size=n) + np.array([100.0 if t == "HOT" else 0.0 for t in ticker])}
    columns["fwd_ret"] = np.array([0.5 if t == "FLAT" else v for t, v in zip(ticker, y)])
    names = [c for c in columns if c not in ("ticker", "fwd_ret")]
    got = {(r["ticker"], r["feature"]): r["ic"] for r in explore.rank_correlation(frame(spark, columns), names, blocks).collect()}
    want = ranked(columns)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=1e-12), k


def test_correlation_matrix_leaves_out_missing_values_by_pair(spark):
    r = np.random.default_rng(2)
    x = {"ticker": ["A"] * 400, "fwd_ret": r.normal(size=400), "a": r.normal(size=400), "b": 3 + r.normal(size=400), "flat": np.full(400, 2.0)}
    x["b"] = x["b"] + x["a"]
    x["a"] = np.where(r.uniform(size=400) < 0.2, np.nan, x["a"])
    got = {(r["feature"], r["other"]): r["corr"] for r in explore.correlation_matrix(frame(spark, x), ["a", "b", "flat"]).collect()}
    want = pd.DataFrame(x)[["a", "b", "flat"]].corr()
    assert len(got) == 9
    for (i, j), v in got.items():
        assert v is None if "flat" in (i, j) else v == pytest.approx(want.loc[i, j], abs=1e-12)
    assert got["a", "b"] == got["b", "a"] and got["a", "a"] == 1.0


def test_correlation_matrix_opens_no_row(spark):
    x = {"ticker": ["A"] * 5, "fwd_ret": np.arange(5.0), "a": np.arange(5.0), "b": np.arange(5.0) ** 2}
    plan = explore.correlation_matrix(frame(spark, x), ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    opened = [line for line in plan.splitlines() if "Generate" in line]
    assert opened and all("posexplode(sums" in line for line in opened)  # the tasks' sums, not rows
