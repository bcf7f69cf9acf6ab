"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = cpus or os.cpu_count() or 1
    return tune(
        SparkSession.builder.master(f"local[{n}]")
        .appName("barloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Skips recording a call site for every Column, which dominates building wide selects.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the wide panel plans want; safe to set on any session.

    Generated methods above 8 KB of bytecode are never compiled by the JIT, so beyond that
    size it is faster to let Spark fall back to separately generated projections.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder all executors can reach.

    Clusters name the shared place in `spark.checkpoint.dir`. Only where that is unset
    (single-machine tests) is a temporary folder made, and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = getattr(shared_folder, "_local", None)
        if base is None:
            base = shared_folder._local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"
