"""Bars and vendor-shaped rows derived from the line-item and part tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import rnd

# Digits of the six fields that together identify a line item and fix its order (38 in all,
# enough up to ten thousand million orders).
LINE_KEY = {"l_orderkey": 10, "l_linenumber": 1, "l_partkey": 9, "l_suppkey": 8, "l_quantity": 2, "l_extendedprice": 8}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_order() -> Column:
    """The line key as one number. Aggregates ordered by it keep it in a hash table's row, which a struct cannot be."""
    def digits(name: str, n: int) -> Column:
        value = F.round(F.col(name) * 100) if name == "l_extendedprice" else F.col(name)
        text = value.cast("bigint").cast("string")
        return F.when(F.length(text) <= n, F.lpad(text, n, "0")).otherwise(F.raise_error(F.concat(F.lit(f"{name} is too large: "), text)))

    return F.concat(*(digits(name, n) for name, n in LINE_KEY.items())).cast("decimal(38,0)")


def _lines(spark: SparkSession, sf_dir: str, ticker: Column, *extra: str) -> DataFrame:
    """Line items with ticker, date and a damped unit price.

    The join carries no hint: Spark broadcasts `part` only when its measured size is
    under the threshold, and splits skewed part keys at run time otherwise.
    """
    price = 100 + F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)) / 1000
    return (
        _table(spark, sf_dir, "lineitem")
        .join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            ticker.alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
            rnd(price, 6).alias("px"),
            F.col("l_quantity").alias("q"),
            line_order().alias("k"),
            *extra,
        )
    )


def by_type() -> Column:
    return F.col("p_type")


def by_brand_and_type() -> Column:
    return F.upper(F.concat("p_brand", F.lit(" "), "p_type"))


def daily_bars(spark: SparkSession, sf_dir: str, ticker: Column | None = None) -> DataFrame:
    """One bar per ticker and ship date: first/extreme/last price, VWAP and volume."""
    lines = _lines(spark, sf_dir, by_type() if ticker is None else ticker)
    return lines.groupBy("ticker", "date").agg(
        F.min_by("px", "k").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"),
        rnd(F.sum(F.col("px") * F.col("q")) / F.sum("q"), 6).alias("adj_close"),
        F.sum("q").alias("volume"),
    )


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one raw vendor row, with untidy headers and real defects.

    Several rows share a ticker and date (later ones are corrections), and attributes
    of the line item decide which rows carry a missing price, a zero price, a swapped
    high/low pair, a negative volume, an unreadable date or number, or an outage.
    """
    lines = _lines(
        spark, sf_dir, by_type(), "l_discount", "l_tax", "l_linenumber", "l_returnflag"
    )
    px, day = F.col("px"), F.col("date")
    swapped = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 2)
    outage = (F.month(day) == 3) & (F.dayofmonth(day) <= 12) & (F.col("ticker") == "PROMO")
    text = lambda c: c.cast("string")
    return lines.select(
        "ticker",
        F.when(F.col("l_tax") == 0.07, F.lit("n/a")).otherwise(text(day)).alias("Date"),
        text(rnd(px - F.col("l_tax"), 6)).alias("Open"),
        text(F.when(swapped, px - 1.0).otherwise(px + 1.0)).alias("High"),
        text(F.when(swapped, px + 1.0).otherwise(px - 1.0)).alias("Low"),
        text(F.when(outage, F.lit(0.0)).otherwise(px)).alias("Close "),
        F.when(F.col("l_discount") == 0.1, F.lit(None).cast("string"))
        .otherwise(text(px)).alias("Adj Close"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "R"), text(-F.col("q")))
        .when((F.col("l_linenumber") == 6) & (F.col("l_tax") == 0.01), F.lit("bad"))
        .otherwise(text(F.col("q"))).alias(" Volume"),
        F.col("k").alias("_seq"),
    )
