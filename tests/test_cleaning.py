import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning as C
from barloom.params import DataParams
from barloom.plans import catalog
from barloom.sources import bars as bar_files
from barloom.sources.session import shared_folder

SCHEMA = "ticker string, Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double, _seq long"
# A week of one ticker: a price is corrected twice, a quote lacks its close-based price, a range is upside down,
# a volume is below zero, a price is zero, and three weeks pass.
ROWS = [
    ("x", "2023-05-01", 20.0, 22.0, 19.0, 21.0, 20.5, 900.0, 1),
    ("x", "2023-05-02", 21.0, 23.0, 20.0, 22.0, 21.5, 800.0, 2),
    ("x", "2023-05-02", 21.0, 23.0, 20.0, 22.2, 21.7, 810.0, 5),
    ("x", "2023-05-02T16:00:00+02:00", 21.0, 23.5, 20.0, 22.4, 21.9, 820.0, 9),
    ("x", "2023-05-03", 22.0, 23.0, 24.0, 22.5, None, 700.0, 3),
    ("x", "2023-05-04", 22.0, 24.0, 21.0, 23.0, 22.5, -1.0, 4),
    ("x", "2023-05-05", 0.0, 24.0, 21.0, 23.0, 22.5, 600.0, 6),
    ("x", "2023-05-26", 25.0, 26.0, 24.0, 25.5, 25.0, 500.0, 7),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_defects_are_counted_and_repaired(raw):
    candidates = C.daily_candidates(raw)
    report = C.cleaning_report(candidates).first().asDict()
    assert {k: report[k] for k in ("rows_in", "rows_out", *C.COUNTERS)} == {
        "rows_in": 8, "rows_out": 4, "duplicate_dates_dropped": 2, "missing_adj_close_dropped": 1, "nonpositive_price_dropped": 1,
        "inconsistent_high_low_nulled": 0, "negative_volume_nulled": 1, "calendar_gaps_over_5_days": 1}
    rows = {str(r.date)[-2:]: r for r in C.clean_bars(candidates).collect()}
    assert sorted(rows) == ["01", "02", "04", "26"] and rows["02"].adj_close == 21.9
    assert rows["04"].volume is None and rows["01"].ticker == "X"


def test_inconsistent_pair_is_blanked_not_dropped(raw):
    candidates = C.daily_candidates(raw.fillna({"Adj Close": 22.1}))
    row = C.clean_bars(candidates).where("date = '2023-05-03'").first()
    assert row.high is None and row.low is None and row.close == 22.5
    assert C.cleaning_report(candidates).first().inconsistent_high_low_nulled == 1


def test_the_last_copy_wins_however_rows_are_dealt(raw):
    want = sorted(C.clean_bars(C.daily_candidates(raw)).collect())
    for n in (1, 3, 8):
        assert sorted(C.clean_bars(C.daily_candidates(raw.repartition(n, "Volume"))).collect()) == want
    with pytest.raises(C.DataError):
        C.daily_candidates(raw.drop("_seq"))


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2023-05-01,1,3,0.5,2,2.5,100\n")
    (tmp_path / "BBB.csv").write_text("Date, close ,Open,Low,High,Volume\n2023-05-01,2,1,0.5,3,100\n2023-05-01,4,1,0.5,5,100\n")
    bars = {r.ticker: r for r in C.clean_bars(C.daily_candidates(bar_files.read_vendor_csv(spark, str(tmp_path)))).collect()}
    assert (bars["AAA"].open, bars["AAA"].close, bars["AAA"].adj_close, bars["AAA"].volume) == (1, 2, 2.5, 100)
    assert (bars["BBB"].open, bars["BBB"].close, bars["BBB"].high, bars["BBB"].adj_close) == (1, 4, 5, 4)
    (tmp_path / "BBB.csv").write_text("Date,Close,Adj Close,Open,Low,High,Volume\n" + "".join(f"2023-05-01,{k},{k},1,0.5,9999,1\n" for k in range(1, 3000)))
    last = C.clean_bars(C.daily_candidates(bar_files.read_vendor_csv(spark, str(tmp_path)).repartition(5))).where("ticker = 'BBB'").first()
    assert last.close == 2999


def test_missing_columns_and_fallback(raw):
    assert C.clean_bars(C.daily_candidates(raw.drop("Adj Close"))).where("adj_close <> close").isEmpty()
    notes = C.schema_notes(["date", "close", "volume"])
    assert len(notes) == 4 and "close stands in" in notes[0]
    with pytest.raises(C.DataError):
        C.standardise(raw.drop("Adj Close", "Close"))
    assert C.tidy_name(("Adj Close", "SPY")) == "adj_close" and C.tidy_name(" Open ") == "open"


def test_missing_open_is_kept_but_zero_open_is_not(spark):
    rows = [("A", "2024-01-01", None, 2.0, 1.0, 1.5, 1.5, 1.0, 1), ("A", "2024-01-02", 0.0, 2.0, 1.0, 1.5, 1.5, 1.0, 2)]
    kept = C.clean_bars(C.daily_candidates(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [str(r.date) for r in kept] == ["2024-01-01"]


def test_last_copy_without_price_loses_the_day(spark):
    rows = [("A", "2024-01-01", 1.0, 2.0, 1.0, 1.5, 1.5, 1.0, 1), ("A", "2024-01-01", 1.0, 2.0, 1.0, 1.5, None, 1.0, 2)]
    candidates = C.daily_candidates(spark.createDataFrame(rows, SCHEMA))
    report = C.cleaning_report(candidates).first()
    assert report.rows_out == 0 and report.duplicate_dates_dropped == 1 and report.missing_adj_close_dropped == 1


def test_unreadable_values(spark):
    raw = spark.createDataFrame(
        [("A", "junk", "1"), ("A", "2024-01-01", "1d"), ("A", "2024-01-02", " 2.5 "), ("A", "2024-01-03", "inf"), ("A", "2024-01-04", "NaN")],
        "ticker string, date string, close string")
    rows = {str(r.date): r.close for r in C.standardise(C.with_order(raw)).collect()}
    assert rows["None"] == 1.0 and rows["2024-01-01"] is None and rows["2024-01-02"] == 2.5
    assert rows["2024-01-03"] is None and rows["2024-01-04"] is None


def test_short_ticker_is_reported_not_fatal(spark, raw):
    short = spark.createDataFrame([("bad", *ROWS[0][1:])], SCHEMA)
    done = C.ingest(raw.unionByName(short), DataParams(tickers=("X", "BAD", "NONE"), market_ticker="X", min_rows=3))
    status = {r.ticker: (r.status, r.action, r.error) for r in done.manifest.collect()}
    assert status["X"][0] == "ok" and status["BAD"][0] == "failed" and "1 clean bars" in status["BAD"][2]
    assert status["NONE"][:2] == ("failed", "absent")
    assert {r.ticker for r in done.bars.select("ticker").distinct().collect()} == {"X"}
    assert done.require_usable(["X", "BAD"]) is done
    with pytest.raises(C.DataError):
        done.require_usable(["BAD"])


def test_trim_is_inclusive(spark, raw):
    bars = C.clean_bars(C.daily_candidates(raw))
    assert C.trim(bars, "2023-05-02", "2023-05-04").count() == 2


def test_bar_files_round_trip(spark, raw):
    bars = C.clean_bars(C.daily_candidates(raw))
    for fmt in ("csv", "parquet"):
        path = shared_folder(spark)
        bar_files.write_bars(bars, path, fmt)
        back = bar_files.read_bars(spark, path, fmt)
        assert back.exceptAll(bars.select(back.columns)).isEmpty() and back.count() == bars.count()
    path = shared_folder(spark)
    bars.drop("volume").write.parquet(path)
    with pytest.raises(C.DataError):
        bar_files.read_bars(spark, path)
    named = shared_folder(spark)
    bars.drop("ticker").coalesce(1).write.option("header", True).csv(f"{named}/ticker=spy")
    assert bar_files.read_vendor_csv(spark, named).select("ticker").distinct().first()[0].upper() == "SPY"
    assert bar_files.read_bars(spark, named, "csv").agg(F.min("date")).first()[0] == dt.date(2023, 5, 1)


def test_copies_of_a_day_collapse_before_the_shuffle(raw):
    """A day with any number of copies leaves each task as one record."""
    plan = C.daily_candidates(raw)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "SortAggregate" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["daily_bars", "clean_bars", "cleaning_report", "deduplicated_days"])
def test_registered_queries_do_not_sort_raw_rows(spark, small, name):
    plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
