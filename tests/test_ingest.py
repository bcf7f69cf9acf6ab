"""Incremental ingest: what is read, what is rebuilt, and that the result equals a whole ingest."""

import csv
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.params import DataParams
from barloom.sources import ingest
from barloom.sources.bars import read_vendor_csv
from barloom.operators import cleaning
from barloom.sources.session import shared_folder

P = DataParams(min_rows=2)


def put(folder, name, rows, header=("Date", "Open", "High", "Low", "Close", "Adj Close", "Volume")):
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header, *rows])
    return path


def day(d, price):
    return (f"2024-01-{d:02d}", price, price + 1, price - 1, price, price, 10)


def whole(spark, source):
    candidates = cleaning.daily_candidates(read_vendor_csv(spark, source))
    return cleaning.enough_history(cleaning.trim(cleaning.clean_bars(candidates), P.start, P.end), P.min_rows)


def same(spark, source, out):
    columns = ["ticker", "date", "open", "high", "low", "close", "adj_close", "volume"]
    got = ingest.read_ingested(spark, out).select(columns).orderBy("ticker", "date").collect()
    assert got == whole(spark, source).select(columns).orderBy("ticker", "date").collect()
    return got


def actions(done):
    return {r["ticker"]: r["action"] for r in done.manifest.collect()}


def test_only_changed_files_are_read(spark, tmp_path):
    source, out = f"{tmp_path}/raw", shared_folder(spark)
    for t, base in (("AAA", 10), ("BBB", 20), ("00C", 30), ("SHORT", 40)):
        put(source, f"{t}.csv", [day(d, base + d) for d in range(1, 3 if t != "SHORT" else 2)])
    done = ingest.update(spark, source, out, P, False)
    assert (done.files_read, done.files_unchanged, done.files_gone) == (4, 0, 0)
    assert actions(done) == dict.fromkeys(("AAA", "BBB", "00C", "SHORT"), "loaded")
    assert {r["ticker"] for r in same(spark, source, out)} == {"AAA", "BBB", "00C"}

    done = ingest.update(spark, source, out, P, False)
    assert (done.files_read, done.files_unchanged) == (0, 4) and set(actions(done).values()) == {"unchanged"}

    # One file changed, one new file of a known ticker that corrects a day, one gone, one new ticker.
    time.sleep(0.02)
    put(source, "AAA.csv", [day(d, 11 + d) for d in range(1, 4)])
    put(source, "ticker=BBB/more.csv", [("2024-01-02", 99, 100, 98, 99, 99, 5)])
    put(source, "NEW.csv", [day(d, 50) for d in range(1, 5)])
    os.remove(Path(source) / "00C.csv")
    os.utime(Path(source) / "ticker=BBB/more.csv", (2_000_000_000, 2_000_000_000))
    done = ingest.update(spark, source, out, P, False)
    assert (done.files_read, done.files_unchanged, done.files_gone) == (4, 1, 1)
    assert actions(done) == {"AAA": "loaded", "BBB": "loaded", "NEW": "loaded", "SHORT": "unchanged", "00C": "removed"}
    rows = same(spark, source, out)
    assert [r["close"] for r in rows if r["ticker"] == "BBB"] == [21.0, 99.0]

    # A ticker that has too few bars now loses its bars.
    time.sleep(0.02)
    put(source, "NEW.csv", [day(1, 50)])
    done = ingest.update(spark, source, out, P, False)
    assert done.files_read == 1 and {r["ticker"]: r["status"] for r in done.manifest.collect()}["NEW"] == "failed"
    assert {r["ticker"] for r in same(spark, source, out)} == {"AAA", "BBB"}


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """A file whose facts are unchanged may even hold something else: nobody looks."""
    source, out = f"{tmp_path}/raw", shared_folder(spark)
    for t in ("AAA", "BBB"):
        put(source, f"{t}.csv", [day(d, 5) for d in (1, 2)])
    ingest.update(spark, source, out, P, False)
    path = Path(source) / "BBB.csv"
    facts, size = path.stat(), len(path.read_bytes())
    path.write_bytes(b"x" * size)
    os.utime(path, ns=(facts.st_atime_ns, facts.st_mtime_ns))
    put(source, "AAA.csv", [day(d, 6) for d in (1, 2, 3)])
    done = ingest.update(spark, source, out, P, False)
    assert done.files_read == 1 and actions(done) == {"AAA": "loaded", "BBB": "unchanged"}
    assert ingest.read_ingested(spark, out).where("ticker = 'BBB'").count() == 2


def test_files_of_several_tickers_and_requested_tickers(spark, tmp_path):
    source, out = f"{tmp_path}/raw", shared_folder(spark)
    header = ("Ticker", "Date", "Close")
    put(source, "one.csv", [("a", f"2024-01-0{d}", 1) for d in (1, 2)] + [("b", f"2024-01-0{d}", 2) for d in (1, 2)], header)
    put(source, "two.csv", [("b", "2024-01-03", 3), ("c", "2024-01-01", 3), ("c", "2024-01-02", 3)], header)
    params = DataParams(tickers=("A", "B", "GHOST"), min_rows=2)
    done = ingest.update(spark, source, out, params, False)
    assert actions(done) == {"A": "loaded", "B": "loaded", "GHOST": "absent"}
    assert {(r["ticker"], r["n"]) for r in ingest.read_ingested(spark, out).groupBy("ticker").agg(F.count("*").alias("n")).collect()} == {("A", 2), ("B", 3)}
    time.sleep(0.02)
    put(source, "two.csv", [("b", "2024-01-03", 4), ("b", "2024-01-04", 4)], header)
    done = ingest.update(spark, source, out, params, False)
    assert done.files_read == 2 and actions(done) == {"A": "unchanged", "B": "loaded", "GHOST": "absent"}
    assert ingest.read_ingested(spark, out).where("ticker = 'B' and close = 4").count() == 2


def test_no_files_yet(spark, tmp_path):
    os.makedirs(f"{tmp_path}/raw")
    put(f"{tmp_path}/raw", "note.txt", [])
    out = shared_folder(spark)
    assert ingest.read_ingested(spark, out).count() == 0
    done = ingest.update(spark, f"{tmp_path}/raw", out, DataParams(tickers=("A",), min_rows=1), False)
    assert actions(done) == {"A": "absent"} and done.files_read == 0
    with pytest.raises(Exception):
        ingest.update(spark, f"{tmp_path}/nowhere", out, P, False)


def test_vendor_files_are_written_by_many_tasks_and_keep_days_whole(spark, small, monkeypatch):
    from barloom.plans import catalog
    from barloom.sources import tpch

    def days(path):
        rows = spark.read.option("header", True).csv(path)
        return rows.select("ticker", "Date", F.col("_metadata.file_path").alias("file"))

    rows, path = tpch.vendor_rows(spark, small), shared_folder(spark)
    monkeypatch.setattr(catalog, "TASK_BYTES", 20_000)
    catalog._write_vendor(spark, small, rows, path)
    found = days(path)
    files = found.groupBy("ticker").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n")).collect()
    assert min(r.files for r in files) > 3 and sum(r.n for r in files) == rows.count()
    assert found.where("Date <> 'n/a'").groupBy("ticker", "Date").agg(F.count_distinct("file").alias("files")).where("files > 1").isEmpty()
    assert found.where("Date = 'n/a'").select("file").distinct().count() > 10
    clean = catalog.QUERIES["vendor_csv_clean"](spark, small)
    monkeypatch.undo()
    assert clean.exceptAll(catalog.QUERIES["vendor_csv_clean"](spark, small)).isEmpty()
