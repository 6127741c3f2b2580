"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and driver and executors are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="rdfloom-")
        sc.setCheckpointDir(at)
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, materialised by checkpoint()."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
