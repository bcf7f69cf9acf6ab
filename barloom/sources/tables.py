"""Durable cut points: panel, predictions, metric tables, manifests and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.panel import panel_schema
from barloom.params import ResearchParams
from barloom.sources.session import shared_folder


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own tables; nothing happens if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def save_panel(panel: DataFrame, path: str, params: ResearchParams | None = None) -> None:
    """Panel as Parquet plus its JSON descriptor next to it."""
    panel.write.mode("overwrite").parquet(f"{path}/panel")
    stored = panel.sparkSession.read.parquet(f"{path}/panel")
    panel_schema(stored, params).write.mode("overwrite").json(f"{path}/schema")


def load_panel(
    spark: SparkSession, path: str, build: Callable[[], DataFrame] | None = None,
    params: ResearchParams | None = None, rebuild: bool = False,
) -> DataFrame:
    """The stored panel, building and storing it first when absent or asked to."""
    if build is not None and (rebuild or not _exists(spark, f"{path}/panel/_SUCCESS")):
        save_panel(build(), path, params)
    return spark.read.parquet(f"{path}/panel")


def save_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").partitionBy("split").parquet(path)


def load_predictions(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """Predictions of the named splits (folders pruned); an absent split is simply empty."""
    table = spark.read.parquet(path)
    table = table.withColumn("split", F.col("split").cast("string"))
    return table.where(F.col("split").isin(splits)) if splits else table


def save_table(table: DataFrame, path: str) -> None:
    """A small result table for people and programs: CSV and JSON side by side."""
    table.repartition(1).write.mode("overwrite").json(f"{path}/json")  # the finished rows move, their computation stays spread
    rows = table.sparkSession.read.schema(table.schema).json(f"{path}/json")
    flat = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else f.name
        for f in table.schema.fields
    ]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def file_facts(spark: SparkSession, folder: str) -> tuple[tuple[str, int, int], ...]:
    """(path, size, change time) of every file below a folder, in order."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    listing = path.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while listing.hasNext():
        status = listing.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: a cut point that outlives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def safe_name(name: str) -> str:
    """A model name that can stand in a path."""
    return name.translate(str.maketrans({"[": "_", "]": None, "/": "_"}))


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{safe_name(name)}")


def load_models(spark: SparkSession, path: str, names: list[str]) -> dict[str, PipelineModel]:
    """The stored models among `names`; missing ones are left out."""
    found = {}
    for name in names:
        try:
            found[name] = PipelineModel.load(f"{path}/{safe_name(name)}")
        except AnalysisException:
            continue
        except Exception as error:
            if "does not exist" not in str(error):
                raise
    return found
