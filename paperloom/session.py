"""Spark session settings shared by the tests, the benchmark and stand-alone use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(name: str = "paperloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume: UTC, AQE, Arrow.

    On a cluster the session comes from ``spark-submit``; nothing in the library
    depends on this helper.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def working_dir(spark: SparkSession, label: str) -> str:
    """A new folder for files that Spark writes on the way: in the shared one that the cluster names. Only a
    local session may do without, and then uses a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or f'file://{tempfile.gettempdir()}/paperloom-work').rstrip('/')}/{label}-{uuid.uuid4().hex}"
