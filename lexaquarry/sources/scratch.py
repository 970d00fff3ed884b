"""Tables that a query writes for itself, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """Under ``spark.checkpoint.dir``; a local folder only where that isn't set and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexaquarry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{name.replace('/', '-')}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
