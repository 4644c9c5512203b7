"""Shared scratch tables: the one place where lineage is cut.

Intermediate tables are Parquet files below ``spark.checkpoint.dir``, the folder which every
executor and the driver share. They survive the loss of executors; a lost task only reads its
input again. Where the setting is absent (tests, a laptop) a local folder is set for the session.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI; a folder of this process's own only where it is unset."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        _own.append(found.removeprefix("file://"))
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


@atexit.register
def _clear() -> None:
    for path in _own:
        shutil.rmtree(path, ignore_errors=True)


class Workspace:
    """Named tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: what follows starts from files, not from df's lineage."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        """A table that put() wrote."""
        return self.spark.read.parquet(self.path(name))

    def tidy(self) -> None:
        """Lets go of the shuffle files that no plan needs any more, now rather than some time."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read any more."""
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def local_path(self, name: str) -> str:
        """Makes a folder for plain files, to be opened through pyarrow.fs on any machine."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
        return self.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
