"""Cutting lineage by reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; on a local master without one, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


class Scratch:
    """Tables in the shared folder that go as soon as they are replaced; a checkpoint stays until the folder is cleared."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
        self._at: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """The rows as a table; the one with this name before is deleted, so ``df`` may still read it."""
        at, before = f"{self.path}/{name}-{uuid.uuid4().hex}", self._at.get(name)
        df.write.parquet(at)
        self._at[name] = at
        if before:
            self._delete(before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        self._delete(self._at.pop(name))

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
