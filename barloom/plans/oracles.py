"""Plain SQL for the registered queries, written independently of the Spark plans.

Every statement starts from the given tables. Common table expressions are shared text;
only the ones a query needs are put in front of it.
"""

from __future__ import annotations

import re

RET = (1, 2, 5, 10, 20, 60)
VOL = (5, 10, 20, 60)
MA = (5, 20, 50)


#: Written out here, not taken from the code under test.
DEFINITIONS = {
    **{f"ret_{n}d": f"adjusted-close return over {n} bar(s)" for n in RET},
    **{f"vol_{n}d": f"sample deviation of the last {n} daily returns, times sqrt(252)" for n in VOL},
    **{f"dist_ma_{n}": f"adjusted close relative to its own {n}-bar average, minus one" for n in MA},
    "ma_spread_5_20": "5-bar average relative to the 20-bar average, minus one",
    "hl_range": "same-day high-low range over the close",
    "oc_return": "same-day close over open, minus one",
    "volume_pct_change": "volume relative to the bar before, minus one",
    "volume_rel_ma20": "volume relative to its own 20-bar average",
    **{f"mdd_{n}d": f"deepest fall from a peak inside the last {n} bars" for n in (20, 60)},
    **{f"mkt_ret_{n}d": f"STANDARD {n}-bar return, known 1 bar(s) later" for n in (1, 5, 20)},
    "mkt_vol_20d": "STANDARD deviation of 20 daily returns, known 1 bar(s) later, times sqrt(252)",
}


def r(x: str, places: int = 8) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def cols(names, places: int = 8) -> str:
    return ", ".join(f"{r(n, places)} AS {n}" for n in names)


def roll(fn: str, x: str, n: int, w: str = "PARTITION BY ticker ORDER BY date") -> str:
    frame = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END"


W = "OVER (PARTITION BY ticker ORDER BY date)"


def mdd(n: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    path = f"list(adj_close) {frame}"
    return f"CASE WHEN count(adj_close) {frame} = {n} THEN {path} END AS path{n}"


def worst(n: int) -> str:
    return (f"list_min(list_transform(range(1, {n + 1}), lambda j: "
            f"path{n}[j] / list_max(path{n}[1:j]) - 1)) AS mdd_{n}d")


ASSET = (
    [f"ret_{n}d" for n in RET] + [f"vol_{n}d" for n in VOL] + [f"dist_ma_{n}" for n in MA]
    + ["ma_spread_5_20", "hl_range", "oc_return", "volume_pct_change", "volume_rel_ma20", "mdd_20d", "mdd_60d"]
)
MKT = ["mkt_ret_1d", "mkt_ret_5d", "mkt_ret_20d", "mkt_vol_20d"]
FEATURES = ASSET + MKT


def features_of(source: str) -> str:
    """Asset features of a bars relation, as f0/f1/feat text with that source."""
    rets = ", ".join(f"adj_close / nullif(lag(adj_close, {n}) {W}, 0) - 1 AS ret_{n}d" for n in RET)
    vols = ", ".join(f"({roll('stddev_samp', 'r1', n)}) * sqrt(252) AS vol_{n}d" for n in VOL)
    mas = ", ".join(f"adj_close / ({roll('avg', 'adj_close', n)}) - 1 AS dist_ma_{n}" for n in MA)
    return f"""
      SELECT * EXCLUDE (path20, path60), {worst(20)}, {worst(60)} FROM (
      SELECT date, ticker, adj_close, {rets}, {vols}, {mas},
        ({roll('avg', 'adj_close', 5)}) / ({roll('avg', 'adj_close', 20)}) - 1 AS ma_spread_5_20,
        (high - low) / nullif(close, 0) AS hl_range, close / nullif(open, 0) - 1 AS oc_return,
        v / lag(v) {W} - 1 AS volume_pct_change, v / ({roll('avg', 'v', 20)}) AS volume_rel_ma20,
        {mdd(20)}, {mdd(60)}, lead(adj_close) {W} / adj_close - 1 AS fwd_ret
      FROM (SELECT *, adj_close / nullif(lag(adj_close) {W}, 0) - 1 AS r1,
                   CASE WHEN volume > 0 THEN volume END AS v FROM {source}))"""


def market_of(source: str) -> str:
    rets = ", ".join(f"adj_close / nullif(lag(adj_close, {n}) OVER (ORDER BY date), 0) - 1 AS mkt_ret_{n}d" for n in (1, 5, 20))
    lagged = ", ".join(f"lag({c}) OVER (ORDER BY date) AS {c}" for c in MKT)
    return f"""
      SELECT date, {lagged} FROM (
        SELECT date, {rets}, ({roll('stddev_samp', 'r1', 20, 'ORDER BY date')}) * sqrt(252) AS mkt_vol_20d
        FROM (SELECT *, adj_close / lag(adj_close) OVER (ORDER BY date) - 1 AS r1
              FROM {source} WHERE ticker = 'STANDARD'))"""


LABEL = "CASE WHEN fwd_ret IS NULL THEN NULL WHEN fwd_ret > 0 THEN 1 ELSE 0 END AS target"
WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "fwd_ret"])
KEPT = "NOT (adj_close IS NULL) AND NOT coalesce(least(open, high, low, close, adj_close) <= 0, false)"


def table_of_metrics(source: str, keys: str, threshold: str = "0.5") -> str:
    """All classification metrics of a predictions relation."""
    on = " AND ".join(f"c.{k} = a.{k}" for k in keys.split(", "))
    picked = ", ".join(f"c.{k}" for k in keys.split(", "))
    return f"""
      SELECT {picked}, n, (tp + fn) / n AS base_rate, (tp + fp) / n AS pred_up_rate,
        (tp + tn) / n AS accuracy,
        (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy,
        coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, roc_auc, log_loss, brier,
        tn, fp, fn, tp,
        CASE WHEN greatest(tp + fn, tn + fp) < n THEN list_sum(list_transform(range(tp + tn, n + 1),
          lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
            + i * ln(greatest(tp + fn, tn + fp) / n) + (n - i) * ln(1 - greatest(tp + fn, tn + fp) / n)))) END
          AS acc_pvalue_vs_majority
      FROM (SELECT {keys}, count(*) AS n,
          count(*) FILTER (target = 1 AND p >= {threshold}) AS tp, count(*) FILTER (target = 0 AND p >= {threshold}) AS fp,
          count(*) FILTER (target = 0 AND p < {threshold}) AS tn, count(*) FILTER (target = 1 AND p < {threshold}) AS fn,
          avg(-(target * ln(p) + (1 - target) * ln(1 - p))) AS log_loss, avg((p - target) * (p - target)) AS brier
        FROM (SELECT *, least(greatest(prob_up, 1e-15), 1 - 1e-15) AS p FROM {source}) GROUP BY {keys}) c
      JOIN (SELECT {keys}, (sum(rk) FILTER (target = 1) - sum(target) * (sum(target) + 1) / 2)
              / nullif(sum(target) * (count(*) - sum(target)), 0) AS roc_auc
        FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY prob_up)
                + (count(*) OVER (PARTITION BY {keys}, prob_up) - 1) / 2 AS rk FROM {source})
        GROUP BY {keys}) a ON {on}"""


def positions_of(source: str, bps: float, lag: int, keys: str = "split, strategy") -> str:
    w = f"OVER (PARTITION BY {keys}, ticker ORDER BY date)"
    pos = f"coalesce(lag(signal, {lag}) {w}, 0.0)" if lag else "signal"
    return f"""
      SELECT *, position * fwd_ret AS gross_ret, turnover * {bps} / 10000 AS cost,
        position * fwd_ret - turnover * {bps} / 10000 AS net_ret
      FROM (SELECT {keys}, date, ticker, fwd_ret, position,
              abs(position - coalesce(lag(position) {w}, 0.0)) AS turnover
            FROM (SELECT *, {pos} AS position FROM {source}))"""


def trades_of(source: str, keys: str = "split, strategy") -> str:
    w = f"OVER (PARTITION BY {keys}, ticker ORDER BY date)"
    return f"""
      SELECT {keys}, ticker, any_value(position) AS position, min(date) AS entry, max(date) AS last_day,
        count(*) AS days,
        product(1 + net_ret) * (1 - coalesce(arg_max(CASE WHEN nxt <> position
          THEN nxt_cost * abs(position) / abs(nxt - position) ELSE 0 END, date), 0)) - 1 AS trade_return
      FROM (SELECT *, row_number() {w} - row_number() OVER (PARTITION BY {keys}, ticker, position ORDER BY date) AS island,
              lead(position) {w} AS nxt, lead(cost) {w} AS nxt_cost FROM {source})
      WHERE position <> 0 GROUP BY {keys}, ticker, position, island"""


def risk_of(source: str, keys: str, rf: float = 0.0) -> str:
    w = f"(PARTITION BY {keys} ORDER BY date)"
    drf = f"(pow(1 + {rf}, 1.0 / 252) - 1)"
    return f"""
      SELECT {keys}, days, days / 252 AS years, final - 1 AS cumulative_return,
        CASE WHEN final > 0 THEN pow(final, 252 / days) - 1 ELSE -1.0 END AS annualised_return,
        sd * sqrt(252) AS annualised_volatility,
        CASE WHEN esd > 0 THEN em / esd * sqrt(252) END AS sharpe,
        CASE WHEN esd > 0 THEN em / esd * sqrt(252) * sqrt(days / 252) END AS sharpe_tstat,
        least(0.0, fall) AS max_drawdown,
        CASE WHEN days >= 252 AND fall < 0 THEN
          (CASE WHEN final > 0 THEN pow(final, 252 / days) - 1 ELSE -1.0 END) / abs(fall) END AS calmar,
        hit_rate, turnover_days, n_position_changes, annual_turnover, avg_exposure, total_cost
      FROM (SELECT {keys}, count(*) AS days, arg_max(equity, date) AS final, stddev_samp(net_ret) AS sd,
          avg(net_ret - {drf}) AS em, stddev_samp(net_ret - {drf}) AS esd,
          min(equity / greatest(1.0, peak) - 1) AS fall,
          avg(CASE WHEN exposure > 0 THEN CASE WHEN net_ret > 0 THEN 1.0 ELSE 0.0 END END) AS hit_rate,
          count(*) FILTER (turnover > 0) AS turnover_days, sum(changes)::BIGINT AS n_position_changes,
          avg(turnover) * 252 AS annual_turnover, avg(exposure) AS avg_exposure, sum(cost) AS total_cost
        FROM (SELECT *, max(equity) OVER {w} AS peak FROM (SELECT *, product(1 + net_ret) OVER {w} AS equity FROM {source}))
        GROUP BY {keys})"""


def portfolio_of(source: str, keys: str = "split, strategy") -> str:
    return f"""
      SELECT {keys}, date, avg(net_ret) AS net_ret, avg(gross_ret) AS gross_ret, avg(cost) AS cost,
        avg(turnover) AS turnover, avg(abs(position)) AS exposure, count(*) FILTER (turnover > 0) AS changes
      FROM {source} GROUP BY {keys}, date"""


LS_SIGNAL = "CASE WHEN prob_up >= 0.52 THEN 1.0 WHEN prob_up < 0.48 THEN -1.0 ELSE 0.0 END::DOUBLE"

CTES: dict[str, str] = {
    "l": """SELECT p_type AS ticker, l_shipdate::DATE AS date,
        floor((100 + l_extendedprice / l_quantity / 1000) * 1e6 + 0.5) / 1e6 AS px, l_quantity AS q,
        l_discount, l_tax, l_linenumber, l_returnflag,
        row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "bars": f"""SELECT ticker, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
        arg_max(px, k) AS close, {r('sum(px * q) / sum(q)', 6)} AS adj_close, sum(q) AS volume
      FROM l GROUP BY ticker, date""",
    "vendor": f"""SELECT ticker, k, CASE WHEN l_tax <> 0.07 THEN date END AS date,
        {r('px - l_tax', 6)} AS open,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN px - 1 ELSE px + 1 END AS high,
        CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN px + 1 ELSE px - 1 END AS low,
        CASE WHEN month(date) = 3 AND day(date) <= 12 AND ticker = 'PROMO' THEN 0.0 ELSE px END AS close,
        CASE WHEN l_discount <> 0.1 THEN px END AS adj_close,
        CASE WHEN l_linenumber = 7 AND l_returnflag = 'R' THEN -q
             WHEN l_linenumber = 6 AND l_tax = 0.01 THEN NULL ELSE q END AS volume
      FROM l""",
    "cand": f"""SELECT * EXCLUDE (rn, k), adj_close IS NULL AS is_missing,
        adj_close IS NOT NULL AND coalesce(least(open, high, low, close, adj_close) <= 0, false) AS is_nonpositive,
        {KEPT} AS is_kept
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY k DESC) AS rn,
              count(*) OVER (PARTITION BY ticker, date) AS copies FROM vendor WHERE date IS NOT NULL) WHERE rn = 1""",
    "clean": """SELECT ticker, date, open, CASE WHEN high < low THEN NULL ELSE high END AS high,
        CASE WHEN high < low THEN NULL ELSE low END AS low, close, adj_close,
        CASE WHEN volume < 0 THEN NULL ELSE volume END AS volume FROM cand WHERE is_kept""",
    "gaps": """SELECT ticker, count(*) FILTER (step > 5) AS gaps FROM (
        SELECT ticker, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS step FROM clean) GROUP BY ticker""",
    "report": """SELECT v.ticker, rows_in, coalesce(rows_out, 0) AS rows_out, duplicate_dates_dropped,
        missing_adj_close_dropped, nonpositive_price_dropped, inconsistent_high_low_nulled, negative_volume_nulled,
        gaps AS calendar_gaps_over_5_days, first_date, last_date
      FROM (SELECT ticker, count(*) AS rows_in FROM vendor GROUP BY ticker) v
      JOIN (SELECT ticker, sum(copies - 1)::BIGINT AS duplicate_dates_dropped,
          count(*) FILTER (is_missing) AS missing_adj_close_dropped,
          count(*) FILTER (is_nonpositive) AS nonpositive_price_dropped,
          count(*) FILTER (is_kept AND high < low) AS inconsistent_high_low_nulled,
          count(*) FILTER (is_kept AND volume < 0) AS negative_volume_nulled,
          count(*) FILTER (is_kept) AS rows_out,
          min(date) FILTER (is_kept) AS first_date, max(date) FILTER (is_kept) AS last_date FROM cand GROUP BY ticker) c
        ON v.ticker = c.ticker JOIN gaps g ON g.ticker = c.ticker""",
    "trimmed": "SELECT * FROM clean WHERE date BETWEEN DATE '1995-07-01' AND DATE '2001-06-30'",
    "gated": "SELECT * FROM trimmed WHERE ticker IN (SELECT ticker FROM trimmed GROUP BY ticker HAVING count(*) >= 2000)",
    "gfeat": features_of("gated"),
    "gmkt": market_of("gated"),
    "gpanel": f"SELECT * FROM (SELECT f.*, gmkt.* EXCLUDE (date), {LABEL} FROM gfeat f LEFT JOIN gmkt ON f.date = gmkt.date) WHERE {WHOLE}",
    "feat": features_of("bars"),
    "mkt": market_of("bars"),
    "fullp": f"SELECT f.* EXCLUDE (adj_close), mkt.* EXCLUDE (date), {LABEL} FROM feat f LEFT JOIN mkt ON f.date = mkt.date",
    "panel": f"SELECT * FROM fullp WHERE {WHOLE}",
    "axis": """SELECT date, row_number() OVER (ORDER BY date) - 1 AS ordinal, count(*) OVER () AS n_dates, n_rows
      FROM (SELECT date, count(*) AS n_rows FROM panel GROUP BY date)""",
    "seg": """SELECT *, CASE WHEN ordinal < tr - 1 THEN 'train' WHEN ordinal >= tr AND ordinal < tr + va - 1 THEN 'validation'
        WHEN ordinal >= tr + va THEN 'test' END AS split
      FROM (SELECT *, floor(n_dates * 0.6e0)::BIGINT AS tr, floor(n_dates * 0.2e0)::BIGINT AS va FROM axis)""",
    "tagged": "SELECT p.*, s.ordinal, s.split FROM panel p JOIN seg s ON p.date = s.date",
    "segsum": """SELECT split AS name, min(date) AS start, max(date) AS "end", count(*) AS n_dates,
        sum(n_rows)::BIGINT AS n_rows FROM seg WHERE split IS NOT NULL GROUP BY split""",
    "folds4": """SELECT i AS fold, 0::BIGINT AS train_from, greatest(n - (4 - i) * (n // 5) - 1, 0) AS train_to,
        n - (4 - i) * (n // 5) AS test_from, n - (4 - i) * (n // 5) + n // 5 AS test_to
      FROM (SELECT count(*) AS n FROM axis), range(4) t(i)""",
    "wf": """SELECT k AS fold, greatest(400 + k * 126 - 1, 1) AS train_to, 400 + k * 126 AS test_from,
        least(400 + (k + 1) * 126, n) AS test_to
      FROM (SELECT count(*) AS n FROM axis), range(1000) t(k) WHERE 400 + k * 126 < n""",
    "priors": """SELECT 'validation' AS split, avg(target) AS prior FROM tagged WHERE split = 'train'
      UNION ALL SELECT 'test', avg(target) FROM tagged WHERE split IN ('train', 'validation')""",
    "major": """SELECT date, ticker, split, 'majority' AS model, prior AS prob_up, target, fwd_ret
      FROM tagged JOIN priors USING (split)""",
    "sc0": f"SELECT date, ticker, split, target, fwd_ret, 0.5e0 + 20e0 * ret_5d / (2e0 * (1e0 + abs(20e0 * ret_5d))) AS p FROM tagged WHERE split IN ('validation', 'test')",
    "scored": """SELECT date, ticker, split, 'momentum' AS model, p AS prob_up, target, fwd_ret FROM sc0
      UNION ALL SELECT date, ticker, split, 'reversal', 1 - p, target, fwd_ret FROM sc0
      UNION ALL SELECT date, ticker, split, 'constant', 0.5::DOUBLE, target, fwd_ret FROM sc0""",
    "preds": "SELECT * FROM scored UNION ALL SELECT date, ticker, split, model, prob_up, target, fwd_ret FROM major",
    "cls": table_of_metrics("preds", "split, model"),
    "frame": f"SELECT m.split, m.date, m.ticker, m.fwd_ret, {r('dist_ma_50')} AS trend FROM major m JOIN panel p ON m.date = p.date AND m.ticker = p.ticker",
    "bsig": """SELECT split, 'always_long' AS strategy, date, ticker, fwd_ret, 1.0::DOUBLE AS signal FROM frame
      UNION ALL SELECT split, 'ma_rule_50d', date, ticker, fwd_ret, CASE WHEN trend > 0 THEN 1.0 ELSE 0.0 END::DOUBLE FROM frame""",
    "msig": """SELECT split, model AS strategy, date, ticker, fwd_ret, CASE WHEN prob_up >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS signal FROM preds""",
    "sig": "SELECT * FROM msig UNION ALL SELECT * FROM bsig",
    "pos": positions_of("sig", 5.0, 0),
    "lsig": f"SELECT split, model AS strategy, date, ticker, fwd_ret, {LS_SIGNAL} AS signal FROM preds",
    "lpos": positions_of("lsig", 10.0, 1),
    "trades": trades_of("pos"),
    "port": portfolio_of("pos"),
    "grid": """SELECT d.split, d.date, t.ticker, coalesce(f.fwd_ret, 0.0) AS r
      FROM (SELECT DISTINCT split, date FROM frame) d JOIN (SELECT DISTINCT split, ticker FROM frame) t ON d.split = t.split
      LEFT JOIN frame f ON f.split = d.split AND f.date = d.date AND f.ticker = t.ticker""",
    "value": """SELECT split, date, avg(g) AS v, count(*) AS tickers FROM (
        SELECT *, product(1 + r) OVER (PARTITION BY split, ticker ORDER BY date) AS g FROM grid) GROUP BY split, date""",
    "bh": """SELECT *, gross_ret - cost AS net_ret, 1.0::DOUBLE AS exposure, CASE WHEN turnover > 0 THEN 1 ELSE 0 END::BIGINT AS changes FROM (
        SELECT split, date, tickers, v / coalesce(lag(v) OVER w, 1.0) - 1 AS gross_ret,
          CASE WHEN lag(v) OVER w IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS turnover,
          CASE WHEN lag(v) OVER w IS NULL THEN 0.0005 ELSE 0.0 END::DOUBLE AS cost
        FROM value WINDOW w AS (PARTITION BY split ORDER BY date))""",
    "ser": """SELECT split, strategy, date, net_ret, gross_ret, cost, turnover, exposure, changes FROM port
      UNION ALL SELECT split, 'buy_and_hold', date, net_ret, gross_ret, cost, turnover, exposure, changes FROM bh""",
    "risk": risk_of("ser", "split, strategy"),
    "bt": """SELECT r.* EXCLUDE (turnover_days),
        CASE WHEN r.strategy = 'buy_and_hold' THEN NULL ELSE t.m END AS avg_trade_return,
        CASE WHEN r.strategy = 'buy_and_hold' THEN (SELECT count(DISTINCT ticker) FROM frame WHERE frame.split = r.split) ELSE coalesce(t.n, 0) END AS n_trades,
        CASE WHEN r.strategy IN ('always_long', 'ma_rule_50d', 'buy_and_hold') THEN 'benchmark' ELSE 'model' END AS kind
      FROM risk r LEFT JOIN (SELECT split, strategy, avg(trade_return) AS m, count(*) AS n FROM trades GROUP BY 1, 2) t
        ON t.split = r.split AND t.strategy = r.strategy""",
    "sens": " UNION ALL ".join(
        f"SELECT split, {lag} AS execution_lag, {bps}::DOUBLE AS cost_bps, annualised_return, sharpe, max_drawdown, annual_turnover, total_cost FROM ("
        + risk_of("(" + portfolio_of("(" + positions_of("(SELECT * FROM msig WHERE strategy = 'momentum')", bps, lag) + ")") + ")", "split, strategy") + ")"
        for lag in (0, 1) for bps in (0.0, 2.0, 5.0, 10.0, 20.0)),
    "tick": f"SELECT split, 'momentum' AS strategy, date, ticker, fwd_ret, {LS_SIGNAL} AS signal FROM preds WHERE model = 'momentum' UNION ALL SELECT split, 'hold_ticker', date, ticker, fwd_ret, 1.0::DOUBLE FROM preds WHERE model = 'momentum'",
    "tickpos": "SELECT *, position AS exposure, CASE WHEN turnover > 0 THEN 1 ELSE 0 END AS changes FROM (" + positions_of("tick", 10.0, 1) + ")",
    "prof": """SELECT split, model, min(prob_up) AS prob_min, max(prob_up) AS prob_max, stddev_pop(prob_up) AS prob_std,
        max(prob_up) - min(prob_up) <= 1e-9 AS constant_prediction,
        avg(CASE WHEN prob_up >= 0.5 THEN 1.0 ELSE 0.0 END) AS long_fraction,
        bool_and(abs(prob_up - 0.5) <= 1e-9) AS on_threshold_tie FROM preds GROUP BY split, model""",
    "act": """SELECT s.split, s.strategy, bool_and(abs(s.net_ret - a.net_ret) <= 1e-12 + 1e-5 * abs(a.net_ret)) AS identical_to_always_long,
        avg(s.net_ret - b.net_ret) AS active_vs_bh_mean_daily,
        CASE WHEN stddev_samp(s.net_ret - b.net_ret) > 0 THEN avg(s.net_ret - b.net_ret) / stddev_samp(s.net_ret - b.net_ret) * sqrt(count(*)) END AS active_vs_bh_tstat
      FROM ser s JOIN port a ON a.split = s.split AND a.date = s.date AND a.strategy = 'always_long'
      JOIN bh b ON b.split = s.split AND b.date = s.date GROUP BY s.split, s.strategy""",
    "diag": """SELECT p.*, a.identical_to_always_long, a.active_vs_bh_mean_daily, a.active_vs_bh_tstat,
        p.model <> 'majority' AND (constant_prediction OR a.identical_to_always_long) AS degenerate
      FROM prof p LEFT JOIN act a ON a.split = p.split AND a.strategy = p.model""",
    "equity": "SELECT split, strategy, date, product(1 + net_ret) OVER (PARTITION BY split, strategy ORDER BY date) AS e FROM ser",
    "byp": """SELECT split, model, prob_up, sum(target)::BIGINT AS pos, (count(*) - sum(target))::BIGINT AS neg FROM preds GROUP BY split, model, prob_up""",
    "rocall": """SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER t AS p, sum(neg) OVER t AS n,
        lead(pos) OVER w AS np, lead(neg) OVER w AS nn, lag(pos) OVER w AS lp
      FROM byp WINDOW w AS (PARTITION BY split, model ORDER BY prob_up DESC), t AS (PARTITION BY split, model)""",
    "ranked": f"""SELECT ticker, feature, corr(rx, ry) AS ic FROM (
        SELECT ticker, feature,
          rank() OVER (PARTITION BY ticker, feature ORDER BY x) + (count(*) OVER (PARTITION BY ticker, feature, x) - 1) / 2 AS rx,
          rank() OVER (PARTITION BY ticker, feature ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY ticker, feature, fwd_ret) - 1) / 2 AS ry
        FROM (UNPIVOT (SELECT ticker, date, fwd_ret, {', '.join(FEATURES)} FROM panel) ON {', '.join(FEATURES)} INTO NAME feature VALUE x))
      GROUP BY ticker, feature""",
    "edges": "SELECT split, model, " + ", ".join(f"quantile_cont(prob_up, {j / 10}) AS e{j}" for j in range(1, 10))
             + " FROM preds WHERE model <> 'majority' GROUP BY split, model HAVING count(DISTINCT prob_up) > 1",
}


def sql(body: str) -> str:
    """Prefix `body` with the shared expressions it uses, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    parts = [f"{name} AS ({text})" for name, text in CTES.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


BAR = "ticker, date, open, high, low, close, adj_close, volume"
RISK = ["years", "cumulative_return", "annualised_return", "annualised_volatility", "sharpe", "sharpe_tstat",
        "max_drawdown", "calmar", "hit_rate", "annual_turnover", "avg_exposure", "total_cost"]
CLS = ["base_rate", "pred_up_rate", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc",
       "log_loss", "brier", "acc_pvalue_vs_majority"]
POS = ["fwd_ret", "position", "turnover", "gross_ret", "cost", "net_ret"]


def feature(*names: str) -> str:
    return f"SELECT date, ticker, {cols(names)} FROM feat"


def fold_sql(folds: str) -> str:
    return f"""SELECT f.fold, min(a.date) FILTER (a.ordinal < f.train_to) AS train_start,
        max(a.date) FILTER (a.ordinal < f.train_to) AS train_end,
        min(a.date) FILTER (a.ordinal >= f.test_from AND a.ordinal < f.test_to) AS test_start,
        max(a.date) FILTER (a.ordinal >= f.test_from AND a.ordinal < f.test_to) AS test_end,
        (sum(a.n_rows) FILTER (a.ordinal < f.train_to))::BIGINT AS train_rows,
        (sum(a.n_rows) FILTER (a.ordinal >= f.test_from AND a.ordinal < f.test_to))::BIGINT AS test_rows
      FROM {folds} f, {{axis}} a GROUP BY f.fold"""


BODIES: dict[str, str] = {
    "daily_bars": f"SELECT {BAR} FROM bars",
    "bars_csv_roundtrip": f"SELECT {BAR} FROM bars",
    "bars_parquet_roundtrip": f"SELECT {BAR} FROM bars",
    "vendor_csv_read": f"""SELECT ticker, count(*) AS n, count(date) AS dated, count(adj_close) AS priced, count(volume) AS with_volume,
        min(date) AS first, max(date) AS last, {r('avg(close)', 6)} AS avg_close, {r('max(high)', 6)} AS max_high FROM vendor GROUP BY ticker""",
    "many_files_universe": "SELECT ticker, count(*) AS bars, min(date) AS first, max(date) AS last FROM bars GROUP BY ticker",
    "panel_roundtrip": f"SELECT date, ticker, {cols(['ret_5d', 'mdd_20d', 'fwd_ret'])}, target FROM panel",
    "panel_schema": f"""SELECT count(*) AS rows, string_agg(DISTINCT ticker, ',' ORDER BY ticker) AS tickers, min(date) AS start,
        max(date) AS "end", '{','.join(FEATURES)}' AS feature_columns, {len(FEATURES)} AS n_definitions, 1 AS horizon FROM panel""",
    "predictions_roundtrip": f"SELECT split, model, count(*) AS n, {r('avg(prob_up)')} AS avg_prob, sum(target)::BIGINT AS ups FROM preds GROUP BY split, model",
    "metric_table_roundtrip": f"SELECT split, strategy, days, {cols(['sharpe', 'total_cost'])} FROM bt",
    "standardised_rows": f"""SELECT ticker, date, count(*) AS n, {r('sum(open)', 5)} AS open, count(volume) AS volumes,
        count(adj_close) AS prices, {r('max(low)', 5)} AS low FROM vendor GROUP BY ticker, date""",
    "adj_close_fallback": """SELECT ticker, date, close, close AS adj_close FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY k DESC) AS rn FROM vendor WHERE date IS NOT NULL)
      WHERE rn = 1 AND least(open, high, low, close) > 0""",
    "absent_columns": """SELECT ticker, date, NULL::DOUBLE AS open, CASE WHEN high >= low THEN high END AS high,
        CASE WHEN high >= low THEN low END AS low, close, adj_close, NULL::DOUBLE AS volume FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY k DESC) AS rn FROM vendor WHERE date IS NOT NULL)
      WHERE rn = 1 AND adj_close IS NOT NULL AND least(high, low, close, adj_close) > 0""",
    "deduplicated_days": """SELECT ticker, date, copies, open, high, low, close, adj_close, volume, is_missing, is_nonpositive,
        is_kept AND coalesce(high < low, false) AS is_inconsistent, is_kept AND coalesce(volume < 0, false) AS is_negative_volume, is_kept FROM cand
      UNION ALL SELECT ticker, NULL, count(*), arg_max(open, k), arg_max(high, k), arg_max(low, k), arg_max(close, k),
        (array_agg(adj_close ORDER BY k DESC))[1], (array_agg(volume ORDER BY k DESC))[1], false, false, false, false, false
      FROM vendor WHERE date IS NULL GROUP BY ticker""",
    "clean_bars": f"SELECT {BAR} FROM clean",
    "calendar_gaps": "SELECT ticker, gaps AS calendar_gaps_over_5_days FROM gaps",
    "cleaning_report": "SELECT * FROM report",
    "trimmed_bars": f"SELECT {BAR} FROM trimmed",
    "enough_history": "SELECT ticker, count(*) AS bars FROM gated GROUP BY ticker",
    "ingest_manifest": """SELECT w.ticker, CASE WHEN p.rows_in IS NULL THEN 'absent' ELSE 'loaded' END AS action,
        CASE WHEN coalesce(t.n, 0) < 2000 THEN 'failed' ELSE 'ok' END AS status, coalesce(t.n, 0) AS rows,
        '1995-07-01' AS start, '2001-06-30' AS "end", p.rows_in, p.duplicate_dates_dropped, p.missing_adj_close_dropped,
        p.nonpositive_price_dropped, p.inconsistent_high_low_nulled, p.negative_volume_nulled,
        p.calendar_gaps_over_5_days, p.first_date, p.last_date
      FROM (VALUES ('PROMO'), ('LARGE'), ('SMALL'), ('NOSUCH'), ('MEDIUM'), ('STANDARD')) w(ticker)
      LEFT JOIN report p ON p.ticker = w.ticker
      LEFT JOIN (SELECT ticker, count(*) AS n FROM trimmed GROUP BY ticker) t ON t.ticker = w.ticker""",
    "universe_status": """SELECT w.ticker, coalesce(n, 0) AS bars, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status
      FROM (VALUES ('PROMO'), ('LARGE'), ('ABSENT'), ('STANDARD')) w(ticker)
      LEFT JOIN (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) b ON b.ticker = w.ticker""",
    "panel_from_vendor_rows": f"SELECT date, ticker, {cols(['ret_20d', 'volume_pct_change', 'volume_rel_ma20', 'hl_range', 'mkt_vol_20d'])}, target FROM gpanel",
    "feature_returns": feature(*(f"ret_{n}d" for n in RET)),
    "feature_volatility": feature(*(f"vol_{n}d" for n in VOL)),
    "feature_ma_distance": feature(*(f"dist_ma_{n}" for n in MA)),
    "feature_ma_spread": feature("ma_spread_5_20"),
    "feature_intraday": feature("hl_range", "oc_return"),
    "feature_volume": f"""SELECT date, ticker, {r(f'v / lag(v) {W} - 1')} AS volume_pct_change,
        {r(f"v / ({roll('avg', 'v', 20)})")} AS volume_rel_ma20
      FROM (SELECT *, CASE WHEN volume % 100 <> 0 AND volume > 0 THEN volume END AS v FROM bars)""",
    "rolling_max_drawdown": feature("mdd_20d", "mdd_60d"),
    "path_max_drawdown": f"""SELECT ticker, {r('min(adj_close / peak - 1)')} AS max_drawdown
      FROM (SELECT *, max(adj_close) {W} AS peak FROM bars) GROUP BY ticker""",
    "path_max_drawdown_with_gaps": f"""SELECT ticker, CASE WHEN count(x) = count(*) THEN {r('min(x / peak - 1)')} END AS max_drawdown
      FROM (SELECT *, max(x) {W} AS peak FROM (SELECT *, CASE WHEN ticker <> 'PROMO' OR date <> DATE '1998-03-13' THEN adj_close END AS x FROM bars))
      GROUP BY ticker""",
    "asset_features": feature(*ASSET),
    "market_features": f"SELECT date, {cols(MKT)} FROM mkt",
    "panel_with_market": f"SELECT date, ticker, {cols([*FEATURES, 'fwd_ret'])}, target FROM fullp",
    "forward_return_label": f"SELECT date, ticker, {cols(['adj_close', 'fwd_ret'])}, {LABEL} FROM feat",
    "forward_return_label_3d": f"""SELECT date, ticker, {cols(['adj_close', 'fwd_ret'])},
        CASE WHEN fwd_ret IS NULL THEN NULL WHEN fwd_ret > 0.002 THEN 1 ELSE 0 END AS target
      FROM (SELECT *, lead(adj_close, 3) {W} / adj_close - 1 AS fwd_ret FROM bars)""",
    "dropped_rows": f"""SELECT ticker, count(*) AS rows, count(*) FILTER ({WHOLE}) AS kept,
        count(*) - count(*) FILTER ({WHOLE}) AS dropped FROM fullp GROUP BY ticker""",
    "feature_panel": f"SELECT date, ticker, {cols([*FEATURES, 'fwd_ret'])}, target FROM panel",
    "feature_panel_in_blocks": f"SELECT date, ticker, {cols([*FEATURES, 'fwd_ret'])}, target FROM panel",
    "feature_dictionary": " UNION ALL ".join(
        f"SELECT {k} AS position, '{f}' AS feature, '{DEFINITIONS[f]}' AS definition, count({f}) AS n, "
        f"{r(f'min({f})')} AS low, {r(f'max({f})')} AS high FROM panel" for k, f in enumerate(FEATURES)),
    "panel_profile": f"""SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, {len(FEATURES)} AS features, min(date) AS start,
        max(date) AS "end", {r('avg(target)')} AS up_rate FROM panel""",
    "date_axis": "SELECT date, ordinal, n_dates, n_rows FROM axis",
    "split_by_fraction": "SELECT date, ordinal, split FROM seg",
    "split_by_date": """SELECT date, ordinal, CASE
        WHEN ordinal < (SELECT count(*) FROM axis WHERE date <= DATE '1999-06-30') - 5 THEN 'train'
        WHEN date > DATE '1999-06-30' AND ordinal < (SELECT count(*) FROM axis WHERE date <= DATE '2000-09-30') - 5 THEN 'validation'
        WHEN date > DATE '2000-09-30' THEN 'test' END AS split FROM axis""",
    "purged_rows": "SELECT date, ticker, ordinal FROM tagged WHERE split IS NULL",
    "split_rows": """SELECT split, ticker, count(*) AS rows, sum(target)::BIGINT AS ups, min(ordinal) AS first, max(ordinal) AS last
      FROM tagged GROUP BY split, ticker""",
    "segment_summary": "SELECT * FROM segsum",
    "chronology_violations": """SELECT a.name, b."end" AS previous_end, a.start FROM segsum a JOIN segsum b
      ON (b.name, a.name) IN (('train', 'validation'), ('validation', 'test')) WHERE b."end" >= a.start""",
    "cv_folds": "SELECT fold, train_from, train_to, test_from, test_to FROM folds4",
    "cv_fold_rows": f"""SELECT fold, role, ticker, count(*) AS rows, min(date) AS first, max(date) AS last, {r('avg(target)')} AS up_rate
      FROM (SELECT f.fold, t.*, CASE WHEN ordinal < test_from THEN 'train' ELSE 'test' END AS role FROM folds4 f
        JOIN tagged t ON t.ordinal < f.test_from - 3 OR (t.ordinal >= f.test_from AND t.ordinal < f.test_to))
      GROUP BY fold, role, ticker""",
    "walk_forward_folds": fold_sql("wf").replace("{axis}", "axis"),
    "development_folds": fold_sql(
        """(SELECT k AS fold, 300 + k * 150 - 2 AS train_to, 300 + k * 150 AS test_from, least(300 + (k + 1) * 150, n) AS test_to
            FROM (SELECT count(*) AS n FROM seg WHERE split IN ('train', 'validation')), range(1000) t(k) WHERE 300 + k * 150 < n)"""
    ).replace("{axis}", """(SELECT date, n_rows, row_number() OVER (ORDER BY date) - 1 AS ordinal FROM seg WHERE split IN ('train', 'validation'))"""),
    "majority_predictions": f"SELECT date, ticker, split, model, {cols(['prob_up', 'fwd_ret'])}, target FROM major",
    "score_predictions": f"SELECT date, ticker, split, model, {cols(['prob_up', 'fwd_ret'])}, target FROM scored",
    "walk_forward_majority": f"""SELECT t.date, t.ticker, 'walk_forward' AS split, 'majority' AS model,
        {r('(SELECT avg(u.target) FROM tagged u WHERE u.ordinal < w.train_to)')} AS prob_up, t.target, {r('t.fwd_ret')} AS fwd_ret, w.fold
      FROM tagged t JOIN wf w ON t.ordinal >= w.test_from AND t.ordinal < w.test_to""",
    "balanced_class_weights": f"""SELECT fold, target, count(*) AS n_class,
        {r('sum(count(*)) OVER (PARTITION BY fold) / (2.0e0 * count(*))')} AS weight
      FROM folds4 JOIN tagged ON ordinal < train_to GROUP BY fold, target""",
    "model_selection": f"""SELECT model, {r('log_loss')} AS log_loss, model = best AS selected, best_score < base AS selected_beats_majority
      FROM (SELECT * FROM cls WHERE split = 'validation'),
        (SELECT arg_min(model, log_loss) FILTER (model <> 'majority') AS best, min(log_loss) FILTER (model <> 'majority') AS best_score,
           min(log_loss) FILTER (model = 'majority') AS base FROM cls WHERE split = 'validation')""",
    "model_selection_by_auc": f"""SELECT model, {r('roc_auc')} AS roc_auc, model = best AS selected, best_score > base AS selected_beats_majority
      FROM (SELECT * FROM cls WHERE split = 'validation'),
        (SELECT arg_max(model, roc_auc) FILTER (model <> 'majority') AS best, max(roc_auc) FILTER (model <> 'majority') AS best_score,
           max(roc_auc) FILTER (model = 'majority') AS base FROM cls WHERE split = 'validation')""",
    "confusion_counts": f"""SELECT split, model, count(*) AS n, count(*) FILTER (target = 1 AND prob_up >= 0.55) AS tp,
        count(*) FILTER (target = 0 AND prob_up >= 0.55) AS fp, count(*) FILTER (target = 0 AND prob_up < 0.55) AS tn,
        count(*) FILTER (target = 1 AND prob_up < 0.55) AS fn,
        {r('avg(-(target * ln(p) + (1 - target) * ln(1 - p)))')} AS log_loss, {r('avg((p - target) * (p - target))')} AS brier
      FROM (SELECT *, least(greatest(prob_up, 1e-15), 1 - 1e-15) AS p FROM preds) GROUP BY split, model""",
    "roc_auc": f"SELECT split, model, {r('roc_auc')} AS roc_auc FROM cls",
    "accuracy_pvalue": f"SELECT split, model, ticker, n, {cols(['accuracy', 'acc_pvalue_vs_majority'])} FROM ("
        + table_of_metrics("preds", "split, model, ticker") + ")",
    "classification_table": f"SELECT split, model, n, tn, fp, fn, tp, {cols(CLS)} FROM cls",
    "signals_long_short": "SELECT split, strategy, signal, count(*) AS n FROM lsig GROUP BY split, strategy, signal",
    "benchmark_signals": "SELECT split, strategy, date, ticker, signal FROM bsig",
    "positions": f"SELECT split, strategy, date, ticker, {cols(POS)} FROM pos",
    "positions_long_short_lagged": f"SELECT split, strategy, date, ticker, {cols(POS)} FROM lpos",
    "trade_list": f"SELECT split, strategy, ticker, position, entry, last_day, days, {r('trade_return')} AS trade_return FROM trades",
    "trade_list_long_short": f"SELECT split, strategy, ticker, position, entry, last_day, days, {r('trade_return')} AS trade_return FROM ("
        + trades_of("lpos") + ")",
    "portfolio_returns": f"SELECT split, strategy, date, {cols(['net_ret', 'gross_ret', 'cost', 'turnover', 'exposure'])}, changes FROM port",
    "buy_and_hold_returns": f"SELECT split, date, tickers, {cols(['net_ret', 'gross_ret', 'cost', 'turnover', 'exposure'])}, changes FROM bh",
    "risk_metrics": f"SELECT split, strategy, days, {cols(RISK)}, turnover_days, n_position_changes FROM (" + risk_of("ser", "split, strategy", 0.03) + ")",
    "backtest_table": f"SELECT split, strategy, kind, days, {cols([*RISK, 'avg_trade_return'])}, n_trades, n_position_changes FROM bt",
    "wide_daily_returns": "SELECT split, date, " + ", ".join(
        f"{r(f'max(net_ret) FILTER (strategy = {chr(39)}{s}{chr(39)})')} AS {s}"
        for s in ("majority", "momentum", "reversal", "constant", "always_long", "ma_rule_50d", "buy_and_hold")) + " FROM ser GROUP BY split, date",
    "sensitivity_table": f"SELECT split, execution_lag, {cols(['cost_bps', 'annualised_return', 'sharpe', 'max_drawdown', 'annual_turnover', 'total_cost'])} FROM sens",
    "per_ticker_table": f"""SELECT k.split, k.ticker, k.strategy,
        {cols(['annualised_return', 'annualised_volatility', 'sharpe', 'max_drawdown', 'hit_rate'])}, coalesce(n, 0) AS n_trades
      FROM ({risk_of('tickpos', 'split, ticker, strategy', 0.02)}) k
      LEFT JOIN (SELECT split, ticker, strategy, count(*) AS n FROM ({trades_of('tickpos')}) GROUP BY 1, 2, 3) t
        ON t.split = k.split AND t.ticker = k.ticker AND t.strategy = k.strategy""",
    "probability_profile": f"SELECT split, model, {cols(['prob_min', 'prob_max', 'prob_std', 'long_fraction'])}, constant_prediction, on_threshold_tie FROM prof",
    "active_returns": f"SELECT split, strategy, identical_to_always_long, {cols(['active_vs_bh_mean_daily', 'active_vs_bh_tstat'], 6)} FROM act",
    "model_diagnostics": f"""SELECT split, model, {cols(['prob_min', 'prob_max', 'prob_std', 'long_fraction', 'active_vs_bh_mean_daily', 'active_vs_bh_tstat'], 6)},
        constant_prediction, on_threshold_tie, identical_to_always_long, degenerate FROM diag""",
    "benchmark_comparison": f"""SELECT b.split, b.strategy AS benchmark, {r('b.sharpe')} AS sharpe, {r('b.annualised_return')} AS annualised_return,
        {r('b.max_drawdown')} AS max_drawdown, {r('s.sharpe')} AS selected_sharpe, {r('s.annualised_return')} AS selected_annualised_return,
        {r('s.max_drawdown')} AS selected_max_drawdown
      FROM bt b JOIN bt s ON s.split = b.split AND s.strategy = 'momentum'
      WHERE b.strategy IN ('buy_and_hold', 'always_long', 'ma_rule_50d', 'majority')""",
    "verdict": f"""SELECT split, {cols(['sharpe', 'best_passive', 'active_vs_bh_tstat', 'lag1_sharpe'], 6)}, degenerate,
        CASE WHEN degenerate THEN 'degenerate' WHEN sharpe > best_passive AND lag1_sharpe > best_passive THEN
          CASE WHEN active_vs_bh_tstat > 2 THEN 'beats_passive' ELSE 'nominal_only' END ELSE 'does_not_beat' END AS verdict
      FROM (SELECT s.split, s.sharpe, greatest(h.sharpe, a.sharpe) AS best_passive, d.active_vs_bh_tstat, d.degenerate, x.sharpe AS lag1_sharpe
        FROM bt s JOIN bt h ON h.split = s.split AND h.strategy = 'buy_and_hold' JOIN bt a ON a.split = s.split AND a.strategy = 'always_long'
        JOIN diag d ON d.split = s.split AND d.model = s.strategy JOIN sens x ON x.split = s.split AND x.execution_lag = 1 AND x.cost_bps = 5
        WHERE s.strategy = 'momentum')""",
    "best_live_model": f"""SELECT m.model, {r('m.log_loss', 6)} AS validation_log_loss, {r('b.sharpe', 6)} AS sharpe,
        {r('greatest(h.sharpe, a.sharpe)', 6)} AS best_passive, {r('d.active_vs_bh_tstat', 6)} AS active_vs_bh_tstat,
        {r('d.long_fraction', 6)} AS long_fraction, {r('c.roc_auc', 6)} AS roc_auc,
        b.sharpe > greatest(h.sharpe, a.sharpe) AND coalesce(d.active_vs_bh_tstat > 2, false) AS beats_passive
      FROM (SELECT model, log_loss FROM cls WHERE split = 'validation' AND model <> 'majority'
              AND model NOT IN (SELECT model FROM diag WHERE split = 'test' AND degenerate) ORDER BY log_loss, model LIMIT 1) m
      JOIN bt b ON b.strategy = m.model AND b.split = 'test' JOIN bt h ON h.strategy = 'buy_and_hold' AND h.split = 'test'
      JOIN bt a ON a.strategy = 'always_long' AND a.split = 'test' JOIN diag d ON d.model = m.model AND d.split = 'test'
      JOIN cls c ON c.model = m.model AND c.split = 'test'""",
    "last_data_date": "SELECT max(d) AS last_date, min(d) AS earliest_last_date, count(*) AS tickers FROM (SELECT max(date) AS d FROM bars GROUP BY ticker)",
    "equity_curves": f"""SELECT split, strategy, date, {r('e - 1')} AS cumulative_return,
        {r('e / max(e) OVER (PARTITION BY split, strategy ORDER BY date) - 1')} AS drawdown FROM equity""",
    "rolling_portfolio_volatility": f"""SELECT split, strategy, date,
        {r('(' + roll('stddev_samp', 'net_ret', 63, 'PARTITION BY split, strategy ORDER BY date') + ') * sqrt(252)')} AS rolling_vol FROM ser""",
    "confusion_shares": f"""SELECT split, model, actual, predicted, n, {r('n / greatest(sum(n) OVER (PARTITION BY split, model, actual), 1)')} AS row_share
      FROM (SELECT c.split, c.model, a.actual, a.predicted, CASE a.o WHEN 1 THEN tn WHEN 2 THEN fp WHEN 3 THEN fn ELSE tp END AS n
        FROM cls c, (VALUES (1, 'down', 'down'), (2, 'down', 'up'), (3, 'up', 'down'), (4, 'up', 'up')) a(o, actual, predicted))""",
    "roc_points": f"""SELECT split, model, {r('prob_up')} AS threshold, {r('fp / n')} AS fpr, {r('tp / p')} AS tpr FROM rocall
      WHERE p > 0 AND n > 0 AND NOT (lp IS NOT NULL AND np IS NOT NULL AND np = pos AND nn = neg)
      UNION ALL SELECT split, model, NULL, 0.0, 0.0 FROM (SELECT DISTINCT split, model FROM rocall WHERE p > 0 AND n > 0)""",
    "calibration_curve": f"""SELECT split, model, bin, {r('avg(prob_up)')} AS mean_predicted, {r('avg(target)')} AS observed_rate, count(*) AS n
      FROM (SELECT p.*, {' + '.join(f'(e{j} < prob_up)::INT' for j in range(1, 10))} AS bin FROM preds p JOIN edges USING (split, model))
      GROUP BY split, model, bin""",
    "probability_histogram": """SELECT split, model, least(floor((prob_up - lo) / (hi - lo) * 40), 39)::BIGINT AS bin, count(*) AS n
      FROM (SELECT *, min(prob_up) OVER (PARTITION BY split, model) AS lo, max(prob_up) OVER (PARTITION BY split, model) AS hi
            FROM preds WHERE model <> 'majority') WHERE hi > lo GROUP BY 1, 2, 3""",
    "up_rate_by_year": f"SELECT year(date) AS year, ticker, {r('avg(target)', 3)} AS up_rate FROM panel GROUP BY 1, 2",
    "rank_correlation": f"SELECT ticker, feature, {r('ic')} AS ic FROM ranked",
    "top_features": f"""SELECT ticker, feature, {r('ic')} AS ic, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(ic) DESC NULLS LAST, feature) AS rank FROM ranked) WHERE rank <= 8""",
    "return_autocorrelation": "SELECT ticker, " + ", ".join(f"{r(f'corr(ret_1d, b{k})')} AS lag{k}" for k in range(1, 6))
        + " FROM (SELECT ticker, ret_1d, " + ", ".join(f"lag(ret_1d, {k}) {W} AS b{k}" for k in range(1, 6)) + " FROM panel) GROUP BY ticker",
    "feature_correlation_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS feature, '{b}' AS other, {r(f'corr({a}, {b})')} AS corr FROM panel" for a in FEATURES for b in FEATURES),
    "split_tables_roundtrip": "SELECT * FROM segsum",
    "future_leaks": "SELECT date, ticker, 0::BIGINT AS balance FROM bars WHERE false",
    # The planted feature looks one bar ahead: each ticker's last row up to the cut-off loses that bar.
    "planted_leaks": """SELECT date, ticker, unnest([1, -1])::BIGINT AS balance FROM (
        SELECT ticker, max(date) AS date FROM bars WHERE date <= DATE '1998-06-30' GROUP BY ticker)
      WHERE ticker IN (SELECT ticker FROM bars WHERE date > DATE '1998-06-30')""",
    "planted_chronology_violations": """SELECT name, previous_end, start FROM (
        SELECT *, lag("end") OVER (ORDER BY CASE name WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) AS previous_end FROM (
          SELECT CASE k WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS name, min(date) AS start, max(date) AS "end"
          FROM axis, range(3) t(k) WHERE ordinal >= k * (n_dates // 3) - 5 * k AND ordinal < (k + 1) * (n_dates // 3) GROUP BY k))
      WHERE previous_end >= start""",
    "walk_forward_coverage": """SELECT model, fold, count(*) AS n, count(*) AS distinct_rows, min(date) AS first, max(date) AS last,
        sum(target)::BIGINT AS ups, count(*) AS probabilities
      FROM (SELECT *, ((ordinal - 400) // 504)::INT AS fold FROM tagged WHERE ordinal >= 400),
        (VALUES ('majority'), ('logreg_none'), ('logreg_l1'), ('logreg_l2'), ('random_forest'), ('gbt[mllib]')) m(model)
      GROUP BY model, fold""",
    "linear_walk_forward_coverage": """SELECT model, fold, count(*) AS n, count(*) AS distinct_rows, min(date) AS first, max(date) AS last,
        sum(target)::BIGINT AS ups, count(*) AS probabilities
      FROM (SELECT *, ((ordinal - 400) // 504)::INT AS fold FROM tagged WHERE ordinal >= 400),
        (VALUES ('majority'), ('logreg_none'), ('logreg_l1'), ('logreg_l2')) m(model)
      GROUP BY model, fold""",
    "training_scales": f"""SELECT fold, feature, count(*) AS n, sum(target)::BIGINT AS ups, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS sd
      FROM (UNPIVOT (SELECT f.fold, t.target, {', '.join('t.' + f for f in FEATURES)} FROM tagged t JOIN (
          SELECT i::INT AS fold, 0 AS a, n - (4 - i) * (n // 5) - 1 AS b FROM (SELECT count(DISTINCT date) AS n FROM tagged WHERE split = 'train'), range(4) u(i)
          UNION ALL SELECT 4, 0, 1000000000) f ON t.ordinal >= f.a AND t.ordinal < f.b WHERE t.split = 'train')
        ON {', '.join(FEATURES)} INTO NAME feature VALUE x) GROUP BY fold, feature""",
    "logistic_balance": """SELECT model, round(sum(w * target) / sum(w), 3) AS weighted_score
      FROM (SELECT target, count(*) OVER () / (2.0e0 * count(*) OVER (PARTITION BY target)) AS w FROM tagged WHERE split = 'train'),
        (VALUES ('logreg_none'), ('logreg_l2')) m(model) GROUP BY model""",
    "metadata_splits": f"""SELECT 'split' AS kind, name, n_rows AS rows, NULL::BIGINT AS test_rows FROM segsum
      UNION ALL SELECT 'fold', fold::VARCHAR, train_rows, test_rows FROM ({fold_sql("wf").replace("{axis}", "axis")})""",
    "incremental_ingest": f"""SELECT ticker, CASE ticker WHEN 'PROMO' THEN 'removed' WHEN 'MEDIUM' THEN 'loaded' ELSE 'unchanged' END AS action,
        CASE ticker WHEN 'PROMO' THEN 'failed' ELSE 'ok' END AS status, c.bars, c.first, c.last, {r('c.avg_close', 6)} AS avg_close, false AS more_files_than_medium
      FROM (SELECT DISTINCT ticker FROM clean) LEFT JOIN (
        SELECT ticker, count(*) AS bars, min(date) AS first, max(date) AS last, avg(adj_close) AS avg_close FROM clean
        WHERE ticker <> 'PROMO' AND (date < DATE '1998-01-01' OR ticker = 'MEDIUM') GROUP BY ticker) c USING (ticker)""",
    # Moments of the labels, which an optimal model's scores (with its penalty) must have.
    "logistic_optimality": f"""SELECT * FROM (WITH tw AS MATERIALIZED (SELECT {', '.join(FEATURES)}, target,
          count(*) OVER () / (2.0e0 * count(*) OVER (PARTITION BY target)) AS w FROM tagged WHERE split = 'train'),
        moments AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, (avg(w * target * {f}) - avg({f}) * avg(w * target)) / stddev_pop({f}) AS m FROM tw" for f in FEATURES)}
          UNION ALL SELECT '(intercept)', avg(w * target) FROM tw)
      SELECT model, feature, {r('m', 6)} AS score_moment, {r('m', 6)} AS label_moment
      FROM moments, (VALUES ('logreg_none'), ('logreg_l1'), ('logreg_l2')) v(model))""",
    "reload_difference": "SELECT ticker, count(*) AS n, count(*) AS equal FROM tagged WHERE split = 'test' GROUP BY ticker",
    "mixed_header_csv": "SELECT ticker, date, open, high, low, close, adj_close, volume FROM bars",
    "vendor_csv_clean": f"SELECT {BAR} FROM clean",
}

SQL: dict[str, str] = {name: sql(body) for name, body in BODIES.items()}
