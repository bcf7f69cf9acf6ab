"""What fitted models use: coefficients, tree importances, permutation importance."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.models import Fitted, grouped_scores, with_probability
from barloom.operators.ordered import default_blocks
from barloom.sources.tables import stored

# Fixed value: how many features a summary shows.
NATIVE_TOP = 8


def logistic_coefficients(name: str, model: PipelineModel, train: DataFrame, features: list[str]) -> DataFrame:
    """Log-odds change per standard deviation and per raw unit of each feature.

    The model's coefficients are per raw unit; deviations are over the fitted rows.
    """
    raw = model.stages[-1].coefficients.toArray().tolist()  # one number per feature
    vector = vector_to_array("features")
    sds = train.select(*(vector[j].alias(f"_{j}") for j in range(len(features)))).agg(
        F.array(*(F.stddev_pop(f"_{j}") for j in range(len(features)))).alias("sd")
    )
    rows = F.arrays_zip(
        F.array(*(F.lit(f) for f in features)).alias("feature"),
        F.array(*(F.lit(float(c)) for c in raw)).alias("raw"), F.col("sd").alias("sd"),
    )
    return sds.select(F.inline(rows).alias("feature", "raw", "sd")).select(
        F.lit("coef").alias("kind"), F.lit(name).alias("model"), "feature",
        F.abs(F.col("raw") * F.col("sd")).alias("value"),
        (F.col("raw") * F.col("sd")).alias("coef_per_sd"), F.col("raw").alias("coef_raw_units"),
        F.col("sd").alias("feature_sd"),
        F.lit(None).cast("long").alias("split_count"), F.lit(None).cast("double").alias("gain"),
    )


def split_statistics(model: PipelineModel, spark, path: str) -> DataFrame:
    """Splits and total gain per feature index, read from the saved tree nodes.

    The nodes are a table of their own; nothing is walked on the driver.
    """
    trees = model.stages[-1]
    trees.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    node = "nodeData" if "nodeData" in nodes.columns else None
    flat = nodes.select(f"{node}.*") if node else nodes
    inner = flat.where(F.col("leftChild") >= 0)
    return inner.groupBy(F.col("split.featureIndex").alias("index")).agg(
        F.count("*").alias("split_count"), F.avg("gain").alias("gain")
    )


def tree_importance(
    name: str, kind: str, model: PipelineModel, spark, features: list[str], path: str | None = None
) -> DataFrame:
    """Normalised importance per feature; `kind` is "impurity" or "gain".

    With `path`, average split gain (normalised) and split counts come from the nodes.
    """
    scores = model.stages[-1].featureImportances.toArray().tolist()  # one number per feature
    table = spark.createDataFrame(
        [(j, f, float(s)) for j, (f, s) in enumerate(zip(features, scores, strict=True))],
        "index int, feature string, value double",
    )
    empty = F.lit(None).cast("double")
    if path:
        table = table.join(split_statistics(model, spark, path), "index", "left").withColumn(
            "gain", F.coalesce("gain", F.lit(0.0))
        ).withColumn("split_count", F.coalesce("split_count", F.lit(0)))
        total = F.sum("gain").over(Window.partitionBy(F.lit(1)))
        table = table.withColumn("value", F.when(total > 0, F.col("gain") / total).otherwise(0.0))
    else:
        table = table.withColumn("split_count", F.lit(None).cast("long")).withColumn("gain", empty)
    return table.select(
        F.lit(kind).alias("kind"), F.lit(name).alias("model"), "feature", "value",
        empty.alias("coef_per_sd"), empty.alias("coef_raw_units"), empty.alias("feature_sd"),
        "split_count", "gain",
    )


def numbered(rows: DataFrame, at: str = "_at") -> DataFrame:
    """Add a position 0..n-1, computed block by block, which no run of the same rows changes.

    Blocks come from a hash of row identity, as many as the session has shuffle partitions.
    """
    blocks = default_blocks(rows)
    placed = rows.withColumn("_h", F.xxhash64("date", "ticker")).withColumn("_b", F.pmod("_h", F.lit(blocks)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = placed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_b").orderBy("_h", "date", "ticker")
    return placed.join(F.broadcast(offsets), "_b").withColumn(at, F.col("_o") + F.row_number().over(inside) - 1).drop("_h", "_b", "_o")


#: Rounds of the permutation; each may move a position or leave it.
ROUNDS = 48


def permuted_position(at: Column, n: Column, *key: Column) -> Column:
    """The position of 0..n-1 that position `at` moves to: a keyed bijection, computed from the position alone.

    Every round pairs a position with its mirror image about a keyed centre, and a keyed bit of the pair
    decides whether the two swap. Each round is a bijection for any n, so the whole is one.
    """
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    centres = F.transform(rounds, lambda t: F.pmod(F.xxhash64(*key, t), n))

    def swap(now, centre):
        other = F.pmod(centre - now, n)
        bit = F.xxhash64(F.greatest(now, other), centre, *key).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(now)

    return F.aggregate(centres, at.cast("long"), swap)


def newest_rows(rows: DataFrame, most: int | None) -> DataFrame:
    """The latest `most` rows by date, then ticker; all of them without a cap or with fewer rows."""
    if not most:
        return rows
    from_ = rows.groupBy("date").agg(F.count("*").alias("n"))
    later = Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per calendar date
    left = from_.select("date", (F.lit(most) - F.coalesce(F.sum("n").over(later), F.lit(0))).alias("_left")).where("_left > 0")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.col("ticker").desc()))
    return rows.join(F.broadcast(left), "date").withColumn("_place", place).where("_place <= _left").drop("_place", "_left")


def permutation_scores(
    name: str, fitted: Fitted, rows: DataFrame, features: list[str],
    n_repeats: int = 10, seed: int = 42, scoring: str = "roc_auc",
) -> DataFrame:
    """Score of each (feature, repeat) with that feature permuted among the rows.

    Rows are numbered once. In every repeat each row hands its features to the row that a keyed bijection names, so one
    vector a repeat is shuffled, and features are swapped in one by one afterwards, where the rows are.
    All features and repeats go through the model in one transform.
    """
    base = stored(numbered(rows.select("date", "ticker", "target", vector_to_array("features").alias("_x"))))
    n = base.agg(F.count("*").alias("n")).head()["n"]
    repeats = F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat")
    givers = base.select("_at", F.col("_x").alias("_donor"), repeats).select(
        permuted_position(F.col("_at"), F.lit(max(n, 1)), F.col("repeat"), F.lit(seed)).alias("_at"), "repeat", "_donor")
    mixed = base.select("_at", "target", "_x").join(givers, "_at").select(
        "target", "repeat", "_x", "_donor", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("index"))
    swapped = F.transform(
        "_x", lambda x, k: F.when(k == F.col("index"), F.get("_donor", k)).otherwise(x)
    )
    scored = with_probability(
        fitted, mixed.select("target", "repeat", "index", array_to_vector(swapped).alias("features"))
    )
    return grouped_scores(scored.select("index", "repeat", "target", "prob_up"), scoring, ("index", "repeat"))


def permutation_importance(
    name: str, fitted: Fitted, rows: DataFrame, features: list[str],
    n_repeats: int = 10, seed: int = 42, scoring: str = "roc_auc", max_rows: int | None = None,
) -> DataFrame:
    """Mean and deviation over repeats of the score lost when a feature is permuted, over the newest `max_rows` rows or all."""
    rows = newest_rows(rows, max_rows)
    whole = with_probability(fitted, rows).select(F.lit(0).alias("one"), "target", "prob_up")
    base = grouped_scores(whole, scoring, ("one",)).first()["score"]
    drops = permutation_scores(name, fitted, rows, features, n_repeats, seed, scoring).select(
        "index", (F.lit(base) - F.col("score")).alias("drop")
    )
    label = F.element_at(F.array(*(F.lit(f) for f in features)), F.col("index") + 1)
    return drops.groupBy("index").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"),
        F.count("*").alias("repeats"),
    ).select(F.lit(name).alias("model"), label.alias("feature"), "importance_mean", "importance_std", "repeats")


def significant_features(permutation: DataFrame) -> DataFrame:
    """How many features matter by more than twice their repeat-to-repeat noise."""
    clear = F.col("importance_mean") > 2 * F.col("importance_std")
    return permutation.groupBy("model").agg(
        F.count("*").alias("features"), F.count_if(clear).alias("significant")
    )


def top_features(table: DataFrame, keys: list[str], value: str, k: int, by_size: bool = False) -> DataFrame:
    """The k largest rows per key (by absolute size for charts); ties by name."""
    score = F.abs(value) if by_size else F.col(value)
    order = Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), "feature")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
