"""A folder that the driver and all executors share, for tables that are read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the cluster's shared folder; on one machine, where none is set, below a temporary one of this session."""
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again."""
    path, schema = folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
