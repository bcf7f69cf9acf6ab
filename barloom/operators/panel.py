"""The (date, ticker) panel: trailing features, forward return and label.

Clean bars hold one row per ticker and calendar day, so a per-ticker window group has
a fixed bound (366 rows a year) no matter how much raw data stands behind it.
`in_blocks` cuts longer histories into blocks with exactly the rows of context each
block needs, for calendars where even that is too much for one task.
"""

from __future__ import annotations

from collections.abc import Callable

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import guard, ratio
from barloom.functions.windows import Trailing, ticker_window, up_label
from barloom.params import FeatureParams, MarketParams, ResearchParams, TargetParams

IDS = ("date", "ticker")
FWD_RET = "fwd_ret"
TARGET = "target"
TAGS = ("ordinal", "split", "fold")


def asset_feature_names(p: FeatureParams) -> list[str]:
    return [
        *(f"ret_{n}d" for n in p.return_windows),
        *(f"vol_{n}d" for n in p.volatility_windows),
        *(f"dist_ma_{n}" for n in p.ma_distance_windows),
        f"ma_spread_{p.ma_spread[0]}_{p.ma_spread[1]}",
        "hl_range", "oc_return", "volume_pct_change",
        f"volume_rel_ma{p.volume_ma_window}",
        *(f"mdd_{n}d" for n in p.drawdown_windows),
    ]


def market_feature_names(m: MarketParams) -> list[str]:
    if not m.enabled:
        return []
    return [
        *(f"mkt_ret_{n}d" for n in m.return_windows),
        *(f"mkt_vol_{n}d" for n in m.volatility_windows),
    ]


def feature_names(p: FeatureParams) -> list[str]:
    return asset_feature_names(p) + market_feature_names(p.market_features)


def feature_columns(panel: DataFrame) -> list[str]:
    """Everything that is not an identifier, an outcome or a split tag, in table order."""
    return [c for c in panel.columns if c not in (*IDS, FWD_RET, TARGET, *TAGS)]


def _with_base_columns(bars: DataFrame, keys) -> DataFrame:
    """Columns that windows are taken over: daily return and usable volume."""
    t = Trailing(*keys)
    daily = t.simple_return("adj_close", 1)
    rows = bars.withColumn("_vol", F.when(F.col("volume") > 0, F.col("volume")))
    return t.compute(rows, rows.columns, {"_r1": daily})


def _asset_formulas(p: FeatureParams, t: Trailing) -> dict:
    out = {f"ret_{n}d": t.simple_return("adj_close", n) for n in p.return_windows}
    for n in p.volatility_windows:
        out[f"vol_{n}d"] = t.volatility("_r1", n, p.annualise_volatility)
    for n in p.ma_distance_windows:
        out[f"dist_ma_{n}"] = t.ma_distance("adj_close", n)
    fast, slow = p.ma_spread
    out[f"ma_spread_{fast}_{slow}"] = t.ma_spread("adj_close", fast, slow)
    out["hl_range"] = ratio(F.col("high") - F.col("low"), F.col("close"))
    out["oc_return"] = ratio(F.col("close"), F.col("open")) - 1.0
    out["volume_pct_change"] = t.simple_return("_vol", 1)
    n = p.volume_ma_window
    out[f"volume_rel_ma{n}"] = t.relative_to_mean("_vol", n)
    for n in p.drawdown_windows:
        out[f"mdd_{n}d"] = t.max_drawdown("adj_close", n)
    return out


def asset_features(
    bars: DataFrame, p: FeatureParams | None = None, target: TargetParams | None = None,
    keys: tuple[str, ...] = ("ticker",), keep: tuple[str, ...] = (),
) -> DataFrame:
    """All single-asset features (and, if asked, the outcome) in one exchange and sort."""
    p = p or FeatureParams()
    t = Trailing(*keys)
    out = _asset_formulas(p, t)
    if target is not None:
        out[FWD_RET] = t.forward_return("adj_close", target.horizon)
    rows = t.compute(_with_base_columns(bars, keys), [*IDS, *keep], out)
    if target is not None:
        rows = rows.withColumn(TARGET, up_label(F.col(FWD_RET), target.threshold))
    return rows


def market_features(bars: DataFrame, ticker: str, p: FeatureParams | None = None) -> DataFrame:
    """Index returns and volatilities on the index's own calendar, lagged in rows."""
    p = p or FeatureParams()
    m = p.market_features
    w = ticker_window()
    index = bars.where(F.col("ticker") == ticker.upper()).select("ticker", "date", "adj_close")
    daily = Trailing("ticker")
    index = daily.compute(index, index.columns, {"_r1": daily.simple_return("adj_close", 1)})
    t = Trailing("ticker")
    out = {f"mkt_ret_{n}d": t.simple_return("adj_close", n) for n in m.return_windows}
    for n in m.volatility_windows:
        out[f"mkt_vol_{n}d"] = t.volatility("_r1", n, p.annualise_volatility)
    index = t.compute(index, ["ticker", "date"], out)
    # The join on the date is a broadcast that must not multiply rows: a date with two index bars fails.
    repeated = F.coalesce(F.lag("date").over(w) == F.col("date"), F.lit(False))
    date = guard(repeated, "more than one market bar on a date", F.col("date"), "date").alias("date")
    return index.select(date, *(F.lag(k, m.lag).over(w).alias(k) if m.lag else k for k in out))


def attach_market(features: DataFrame, market: DataFrame) -> DataFrame:
    """Left join on the exact date.

    The market side has one row per calendar day of one ticker (some tens of kilobytes a
    decade), a bound that does not move with the data, hence the broadcast.
    """
    return features.join(F.broadcast(market), "date", "left")


def with_target(bars: DataFrame, target: TargetParams | None = None) -> DataFrame:
    """Forward return and label only."""
    t = target or TargetParams()
    windows = Trailing("ticker")
    outcome = {FWD_RET: windows.forward_return("adj_close", t.horizon)}
    rows = windows.compute(bars, [*IDS, "adj_close"], outcome)
    return rows.withColumn(TARGET, up_label(F.col(FWD_RET), t.threshold))


def full_panel(
    bars: DataFrame, params: ResearchParams | None = None, block_rows: int | None = None
) -> DataFrame:
    """Every bar with its features and outcome, missing values still in place."""
    params = params or ResearchParams()
    p = params.features
    if block_rows:
        blocks = in_blocks(bars, block_rows, p.longest_window() + 1, params.target.horizon)
        rows = asset_features(
            blocks, p, params.target, keys=("ticker", "_block"), keep=("_own",)
        ).where("_own").drop("_own")
    else:
        rows = asset_features(bars, p, params.target)
    if p.market_features.enabled:
        rows = attach_market(rows, market_features(bars, params.data.market(), p))
    universe = params.data.universe()
    if universe:
        rows = rows.where(F.col("ticker").isin(universe))
    return rows.select(*IDS, *feature_names(p), FWD_RET, TARGET)


def complete_rows(panel: DataFrame) -> DataFrame:
    """Drop rows with any missing feature or outcome; nothing is imputed."""
    return panel.dropna("any")


def build_panel(
    bars: DataFrame, params: ResearchParams | None = None, block_rows: int | None = None
) -> DataFrame:
    return complete_rows(full_panel(bars, params, block_rows))


def in_blocks(bars: DataFrame, block_rows: int, before: int, after: int) -> DataFrame:
    """Cut each ticker's calendar into blocks of `block_rows` bars plus exact context.

    Row ordinals come from per-year counts (a small table) and a position within the
    year, so no step ever holds one ticker's whole history in a task. A row is copied
    into the next block when it is among the last `before` rows of its own, and into the
    previous block when among the first `after` rows; `_own` marks the home copy.
    """
    if block_rows < max(before, after):
        raise ValueError(f"block_rows must be at least {max(before, after)}")
    dated = bars.withColumn("_year", F.year("date"))
    earlier = Window.partitionBy("ticker").orderBy("_year").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        dated.groupBy("ticker", "_year").agg(F.count("*").alias("_n"))
        .select("ticker", "_year", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("ticker", "_year").orderBy("date")
    ordinal = F.col("_start") + F.row_number().over(within) - 1
    numbered = dated.join(offsets, ["ticker", "_year"]).withColumn("_ord", ordinal)
    home = F.floor(F.col("_ord") / block_rows)
    place = F.col("_ord") % block_rows
    copies = F.array_compact(
        F.array(
            home,
            F.when(place >= block_rows - before, home + 1),
            F.when((place < after) & (home > 0), home - 1),
        )
    )
    return (
        numbered.withColumn("_home", home)
        .withColumn("_block", F.explode(copies))
        .withColumn("_own", F.col("_block") == F.col("_home"))
        .drop("_year", "_start", "_ord", "_home")
    )


def drop_counts(full: DataFrame) -> DataFrame:
    """Kept and dropped rows per ticker."""
    complete = F.lit(True)
    for c in full.columns:
        complete = complete & F.col(c).isNotNull()
    return full.groupBy("ticker").agg(
        F.count("*").alias("rows"),
        F.count_if(complete).alias("kept"),
        F.count_if(~complete).alias("dropped"),
    )


def panel_profile(panel: DataFrame) -> DataFrame:
    """Size, coverage and base rate of a finished panel, in one row."""
    by_ticker = panel.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b"),
        F.sum(TARGET).alias("up"),
    )
    return by_ticker.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("tickers"),
        F.lit(len(feature_columns(panel))).alias("features"),
        F.min("a").alias("start"),
        F.max("b").alias("end"),
        (F.sum("up") / F.sum("n")).alias("up_rate"),
    )


def feature_dictionary(params: ResearchParams | None = None) -> dict[str, str]:
    """What each feature column means, in panel order."""
    params = params or ResearchParams()
    p, m = params.features, params.features.market_features
    market = params.data.market()
    # Templates by column family; {n} is the window, {m} the slow window or the lag.
    wording = {
        "ret": "adjusted-close return over {n} bar(s)",
        "vol": "sample deviation of the last {n} daily returns",
        "dist_ma": "adjusted close relative to its own {n}-bar average, minus one",
        "ma_spread": "{n}-bar average relative to the {m}-bar average, minus one",
        "hl_range": "same-day high-low range over the close",
        "oc_return": "same-day close over open, minus one",
        "volume_pct_change": "volume relative to the bar before, minus one",
        "volume_rel_ma": "volume relative to its own {n}-bar average",
        "mdd": "deepest fall from a peak inside the last {n} bars",
        "mkt_ret": market + " {n}-bar return, known {m} bar(s) later",
        "mkt_vol": market + " deviation of {n} daily returns, known {m} bar(s) later",
    }
    text = {}
    for name in feature_names(p):
        numbers = [int(x) for x in re.findall(r"\d+", name)]
        family = re.sub(r"_?\d+d?", "", name)
        second = m.lag if family.startswith("mkt") else (numbers[1:] or [0])[0]
        words = wording[family].format(n=(numbers or [0])[0], m=second)
        yearly = family in ("vol", "mkt_vol") and p.annualise_volatility
        text[name] = words + (", times sqrt(252)" if yearly else "")
    return text


def feature_dictionary_table(panel: DataFrame, params: ResearchParams | None = None) -> DataFrame:
    """Definitions beside the observed coverage and range of each feature of a panel."""
    text = feature_dictionary(params)
    names = [c for c in feature_columns(panel) if c in text]
    stats = panel.agg(
        *(F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c)
          for c in names)
    )
    rows = F.array(
        *(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(text[c]).alias("definition"),
            F.col(f"{c}.n").alias("n"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high"),
        ) for i, c in enumerate(names))
    )
    return stats.select(F.inline(rows))


def panel_schema(panel: DataFrame, params: ResearchParams | None = None) -> DataFrame:
    """The descriptor stored beside a panel: size, tickers, range, columns, outcome."""
    params = params or ResearchParams()
    per_ticker = panel.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")
    )
    definitions = feature_dictionary(params)
    pairs = [x for c in feature_columns(panel) for x in (F.lit(c), F.lit(definitions.get(c, "")))]
    return per_ticker.agg(
        F.sum("n").alias("rows"),
        F.sort_array(F.collect_list("ticker")).alias("tickers"),
        F.min("a").alias("start"),
        F.max("b").alias("end"),
    ).select(
        "*",
        F.array(*(F.lit(c) for c in feature_columns(panel))).alias("feature_columns"),
        F.create_map(*pairs).alias("definitions"),
        F.struct(
            F.lit(params.target.horizon).alias("horizon"),
            F.lit(params.target.threshold).alias("threshold"),
        ).alias("target"),
    )


def future_leaks(
    bars: DataFrame, cutoff: str, params: ResearchParams | None = None,
    build: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Feature rows dated up to `cutoff` that change once later bars are removed.

    An empty result shows that no feature on or before the cutoff uses later data. `build` makes
    the panel from bars, `full_panel` unless given.
    """
    params = params or ResearchParams()
    names = feature_names(params.features)
    day = F.lit(cutoff).cast("date")
    make = build or (lambda some: full_panel(some, params))
    whole = make(bars).where(F.col("date") <= day).select(*IDS, *names)
    cut = make(bars.where(F.col("date") <= day)).select(*IDS, *names)
    tagged = whole.withColumn("_side", F.lit(1)).unionByName(cut.withColumn("_side", F.lit(-1)))
    return (
        tagged.groupBy(*IDS, *names).agg(F.sum("_side").alias("balance"))
        .where(F.col("balance") != 0)
        .select(*IDS, "balance")
    )
