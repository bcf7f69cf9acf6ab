"""Helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from barloom.sources.session import shared_folder

#: ASCII white space of the text contracts, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: a cut point that outlives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wider(schema: StructType, *fields: tuple[str, str]) -> StructType:
    """The schema with (name, SQL type) columns added."""
    return StructType([*schema.fields, *(StructField(n, StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in fields)])


_shipped: set[str] = set()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow for functions of this package, which Spark's file server gives the executors once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "barloom_code.zip"  # the driver's copy, served from there
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)


def text_ranges(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters in all; a longer text is a range of its own."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def join_by_count(rows: DataFrame, labels: DataFrame, key: str, count: str) -> DataFrame:
    """Rows with the columns of `labels`, which has each key once and the number of its rows in `count`.

    Keys with more than a quarter of a task's share of rows are broadcast: there can be no more than four a shuffle partition of
    them, whatever the data. So no hot key is shuffled, and the others are small. `labels` should be stored: it is read thrice.
    """
    most = 4 * parallelism(rows.sparkSession)
    total = labels.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).head()["n"]
    plain = labels.drop(count)
    hot = F.broadcast(plain.where(labels[count] > total // most))  # at most `most` rows
    cold = plain.where(labels[count] <= total // most)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
