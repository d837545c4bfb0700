"""Session helpers shared by tests, bench and jobs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, name: str = "streamlens") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; only Spark's own reader touches the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")
