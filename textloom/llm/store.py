"""Tables that cut lineage, in the folder which driver and executors share.

A table written here survives the loss of any executor.  The folder is the one that the cluster names in
``spark.checkpoint.dir``; where that is unset, a folder of our own is made on a local master only, an error is raised elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_owner = ""
_WRITTEN: dict[str, list[str]] = {}  # by owner: paths, and names of tables


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes ``checkpoint()`` usable."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; runs the plan once. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    _WRITTEN.setdefault(_owner, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """Write ``df`` as a table in the warehouse, dealt by a column, so that joins on that column don't shuffle it again."""
    spark, table = df.sparkSession, f"textloom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, by).write.format("parquet").option("compression", "zstd").bucketBy(buckets, by).saveAsTable(table)
    _WRITTEN.setdefault(_owner, []).append(table)
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables written inside belong to ``owner``, whose earlier ones are deleted first; those of others stay."""
    global _owner
    for name in _WRITTEN.pop(owner, []):
        if "/" in name:
            delete(spark, name)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before
