"""Cutting lineage with written tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="streamlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_name(taken: Iterable[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to differ from all taken ones (letters' case does not count)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: what follows starts from these files.

    Losing an executor later costs nothing of what was written. The files stay until the
    cluster clears its shared folder, because the returned DataFrame reads them lazily.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
