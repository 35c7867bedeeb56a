"""A stream source that replays a table: rows of Parquet files in file order, in micro-batches of so many rows.

Register ``TableStream`` and read it with ``spark.readStream.format("textloom_table")``.  Options: ``path`` (a Parquet file or
a folder of them, as pyarrow.fs opens it), ``rows`` (the most rows of a micro-batch, 10000), ``split`` (rows of a partition,
5000).  Files are never changed, new ones may come; a file that comes later is read later, whatever its name.

An offset says how many rows of each file were read, so any range of offsets can be read again, on another executor or
after a restart, and gives the same rows.  After a restart the source goes on from the offset that the checkpoint has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Parquet files and their rows."""
    from pyarrow import fs

    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        names = [at]
    else:
        every = system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        names = [x.path for x in every if x.type == fs.FileType.File and x.path.endswith(".parquet") and "/_" not in x.path]
    return {n: pq.read_metadata(n, filesystem=system).num_rows for n in sorted(names)}


class Range(InputPartition):
    """Rows first to last (exclusive) of a file; ``before`` rows of the stream come earlier."""

    def __init__(self, file: str, first: int, last: int, before: int):
        self.file, self.first, self.last, self.before = file, first, last, before


class TableReader(DataSourceStreamReader):
    def __init__(self, path: str, rows: int, split: int):
        self.path, self.rows, self.split = path, rows, split
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The offset up to ``rows`` rows further than the last one."""
        end, left = dict(self.at), self.rows
        sizes = _files(self.path)
        # files that were begun come first, so their order stays
        for name in [*self.at, *(n for n in sizes if n not in self.at)]:
            n = min(left, sizes.get(name, 0) - end.get(name, 0))
            if n > 0:
                end[name] = end.get(name, 0) + n
                left -= n
        self.at = end
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # Spark asks for an empty range first after a restart, which tells where the checkpoint stands
        self.at = {**end, **{k: v for k, v in self.at.items() if v > end.get(k, 0)}}
        out, before = [], sum(start.values())
        for name, last in end.items():
            first = start.get(name, 0)
            for a in range(first, last, self.split):
                b = min(a + self.split, last)
                out.append(Range(name, a, b, before))
                before += b - a
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Rows of the range with their place in the stream, from the row groups that have them."""
        file = pq.ParquetFile(_open(self.path)[0].open_input_file(partition.file))
        at, n = 0, partition.before
        for group in range(file.num_row_groups):
            size = file.metadata.row_group(group).num_rows
            if at < partition.last and at + size > partition.first:
                part = file.read_row_group(group).slice(max(0, partition.first - at), min(partition.last, at + size) - max(partition.first, at))
                for b in part.to_batches():
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + b.num_rows), pa.int64())], names=[*b.schema.names, "_place"])
                    n += b.num_rows
            at += size


class TableStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_table"

    def schema(self) -> StructType:
        """The files' columns and ``_place``, the number of the row in the stream."""
        names = list(_files(self.options["path"]))
        if not names:
            raise ValueError("no Parquet file tells the columns")
        found = from_arrow_schema(pq.read_schema(names[0], filesystem=_open(self.options["path"])[0]))
        return StructType([*found.fields, StructField("_place", LongType())])

    def streamReader(self, schema: StructType) -> TableReader:
        return TableReader(self.options["path"], int(self.options.get("rows", 10_000)), int(self.options.get("split", 5_000)))


def table_stream(spark: SparkSession, path: str, rows: int = 10_000, split: int = 5_000):
    """A streaming DataFrame of a table's rows and their place."""
    spark.dataSource.register(TableStream)
    return spark.readStream.format("textloom_table").options(path=path, rows=str(rows), split=str(split)).load()
