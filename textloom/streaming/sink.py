"""Upserts of micro-batches into a table of files, published by one rename each.

A version of the table is a manifest: which folder has each bucket's rows, and the last epoch of each stream that was
applied.  A batch rewrites the buckets which its keys fall into, into new folders, and publishes by renaming a
finished manifest to the next version's name.  A batch whose epoch was applied already changes nothing; one that fails
half-way leaves folders that no manifest names, and is applied anew.  Readers see whole versions only.

Two writers of one table can't both publish a version: the rename of the second fails, and its batch is to be retried.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Upserts:
    """A table with one row a key, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found and version is None:
            return {"version": -1, "buckets": {}, "epochs": {}}
        name = f"{self.path}/_manifests/{found[-1] if version is None else version:012d}.json"
        return json.loads("".join(r.value for r in self.spark.read.text(name, wholetext=True).collect()))

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['version']:012d}.json"
        draft, final = self._path(f"{self.path}/_manifests/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.path}/_manifests/{name}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(str(final))

    # -- rows

    def read(self, version: int | None = None) -> DataFrame:
        folders = sorted(set(self.manifest(version)["buckets"].values()))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def apply(self, batch: DataFrame, epoch: int, stream: str = "", deleted: str | None = None, order: str | None = None) -> bool:
        """Put rows of ``batch`` in place of those with the same key; whether it did, or the epoch was applied before.

        Of several rows with one key the last by ``order``, then by all columns, counts.  Rows where the column ``deleted`` is true take their
        key out.  A null key is an error of the batch.
        """
        now = self.manifest()
        if epoch <= now["epochs"].get(stream, -1):
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = batch.withColumn("_bucket", bucket).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most the number of buckets
            if new.where(F.col(self.key).isNull()).limit(1).count():
                raise ValueError(f"a null {self.key}")
            folder = f"data/{now['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            if touched:
                self._rewrite(new, now, touched, folder, deleted, order)
        finally:
            new.unpersist()
        buckets = {**now["buckets"], **{str(b): f"{folder}/_bucket={b}" for b in touched}}
        written = {b: f for b, f in buckets.items() if f.rpartition("/")[0] != folder or self._fs.exists(self._path(f"{self.path}/{f}"))}
        self._publish({"version": now["version"] + 1, "buckets": written, "epochs": {**now["epochs"], stream: epoch}})
        return True

    def _rewrite(self, new: DataFrame, now: dict, touched: list[int], folder: str, deleted: str | None, order: str | None) -> None:
        names = self.schema.names
        last = Window.partitionBy(self.key).orderBy(*([F.desc(order)] if order else []), F.desc(F.struct(*names)))
        new = new.withColumn("_last", F.row_number().over(last)).where("_last = 1")
        put = (new.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else new).select(*names, "_bucket")
        old = [now["buckets"][str(b)] for b in touched if str(b) in now["buckets"]]
        if old:
            before = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in old))
            kept = before.join(new.select(self.key), self.key, "left_anti").withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            put = kept.select(*names, "_bucket").unionAll(put)
        put.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")

    def batches(self, stream: str = "", deleted: str | None = None, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """A function for ``foreachBatch``: each epoch is applied once, however often it comes."""

        def run(batch: DataFrame, epoch: int) -> None:
            self.apply(batch, epoch, stream, deleted, order)

        return run

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests older than the last ``keep``, and folders that no manifest left names."""
        found = self.versions()
        kept = found[-keep:]
        named = {f.rpartition("/")[0] for v in kept for f in self.manifest(v)["buckets"].values()}
        gone = []
        for v in found[: len(found) - len(kept)]:
            self._fs.delete(self._path(f"{self.path}/_manifests/{v:012d}.json"), False)
        data = self._path(f"{self.path}/data")
        for x in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f"data/{x.getPath().getName()}"
            if name not in named:
                self._fs.delete(x.getPath(), True)
                gone.append(name)
        return sorted(gone)
