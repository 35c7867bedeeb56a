"""A searchable index of documents as a data source.

``build_index`` writes postings by term: documents are dealt into shards by a hash of their id; within a shard a term's
postings are dealt by impact, a small integer that grows with the term's frequency in the document, highest first, and
within an impact they are sorted by document in blocks.  A query reads the blocks of its terms only.

``spark.read.format("textloom_search")`` plans a partition for each shard.  A shard goes through the impacts of all query
terms from the highest possible score down, scores the documents it meets there by looking them up in the terms' other
blocks, and ends when no unseen document can be among the best: most documents are never scored.  Each partition gives
its shard's best, ``search`` the page of all.

Options: ``path``; ``query``; ``type`` (``any``, ``all``); ``start``, ``count`` (a page and its size); ``sort``
(``relevance`` or ``id``).  Filters on ``shard``, ``doc_id`` (=, in) and lower bounds of ``score`` are pushed into the
source: shards that can't match aren't planned, and the search ends at the bound.

The score of a document is the sum over the query's distinct terms of impact * rarity; impact = 1000 tf // (tf + 1) with
tf of 15 at most, rarity = 1 + the number of binary digits of n // df.  Of equal scores the smaller id comes first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.window import Window

BLOCK = 4096
_TERMS = r"[a-z0-9]+"


def terms(text: Column) -> Column:
    """Terms of a text: runs of letters a to z and digits, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TERMS), F.lit(0))


def build_index(docs: DataFrame, path: str, shards: int = 8, buckets: int = 16) -> None:
    """Index docs (doc_id, text). Rows with the same id are one document."""
    tf = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    capped = F.least("tf", F.lit(15))
    postings = tf.select("term", "doc_id", F.floor(1000 * capped / (capped + 1)).cast("int").alias("impact"), F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # a block has a bounded number of postings, so a term that every document has is never gathered whole
    place = F.row_number().over(Window.partitionBy("shard", "term", "impact", "range").orderBy("doc_id"))
    ranged = postings.withColumn("range", F.shiftright("doc_id", 16)).withColumn("block", F.floor((place - 1) / BLOCK))
    blocks = ranged.groupBy("shard", "term", "impact", "range", "block").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    rows = blocks.select("shard", bucket.alias("bucket"), "term", "impact", F.col("docs")[0].alias("first"), F.element_at("docs", -1).alias("last"), "docs")
    rows.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket", "term", F.desc("impact"), "first").write.partitionBy("shard", "bucket").option("parquet.block.size", str(4 << 20)).parquet(f"{path}/postings")
    # from the index, so texts are cut into terms once
    written = docs.sparkSession.read.parquet(f"{path}/postings").select("term", F.size("docs").alias("n"))
    df = written.groupBy("term").agg(F.sum("n").alias("df")).withColumn("bucket", bucket)
    df.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms")
    n = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().count()
    docs.sparkSession.createDataFrame([(n, shards, buckets)], "n long, shards int, buckets int").coalesce(1).write.parquet(f"{path}/index")


def _rarity(n: int, df: int) -> int:
    return 1 + (n // df).bit_length()


class Shard(InputPartition):
    def __init__(self, shard: int, terms: list[tuple[str, int, int]]):
        self.shard, self.terms = shard, terms  # (term, bucket, rarity)


class Layers:
    """A term's postings in a shard by impact, highest first; documents of an impact are sorted."""

    def __init__(self, rarity: int, rows: Iterable[tuple[int, np.ndarray]]):
        by: dict[int, list[np.ndarray]] = {}
        for impact, docs in rows:
            by.setdefault(impact, []).append(docs)
        self.layers = [(impact * rarity, np.sort(np.concatenate(by[impact]))) for impact in sorted(by, reverse=True)]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for score, have in self.layers:
            at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
            out[have[at] == docs] = score
        return out


def best(found: Sequence[Layers], k: int, every: bool = False, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, number of documents scored): the k best with ``floor`` at least; every: with all terms."""
    docs, scores, scored = np.empty(0, np.int64), np.empty(0, np.int64), 0
    seen = np.empty(0, np.int64)
    at = [0] * len(found)
    while True:
        tops = [t.layers[i][0] if i < len(t.layers) else 0 for t, i in zip(found, at, strict=True)]
        bound = sum(tops)  # what an unseen document can have at most
        if not bound or bound < floor or (every and 0 in tops):
            break
        if len(scores) >= k and scores[k - 1] > bound:
            break
        i = int(np.argmax(tops))
        new = np.setdiff1d(found[i].layers[at[i]][1], seen, assume_unique=False)
        at[i] += 1
        seen = np.union1d(seen, new)
        scored += len(new)
        each = [t.scores(new) for t in found]
        total = sum(each) if each else np.zeros(len(new), np.int64)
        good = total >= floor
        if every:
            good &= np.all([e > 0 for e in each], axis=0)
        docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, total[good]])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
    return docs, scores, scored


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.query = options["path"].rstrip("/"), options.get("query", "")
        self.kind, self.sort = options.get("type", "any"), options.get("sort", "relevance")
        self.start, self.count = int(options.get("start", 1)), int(options.get("count", 10))
        if self.kind not in ("any", "all") or self.sort not in ("relevance", "id") or self.start < 1 or self.count < 1:
            raise ValueError("type is any or all, sort is relevance or id, start and count are 1 at least")
        self.floor, self.shards, self.ids = 1, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "score" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.floor = max(self.floor, f.value + isinstance(f, GreaterThan))
            elif column in ("shard", "doc_id") and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                if column == "shard":
                    self.shards = values if self.shards is None else self.shards & values
                else:
                    self.ids = values if self.ids is None else self.ids & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """A partition for each shard that can have a match; term statistics are read here once."""
        import re

        import pyarrow.dataset as ds

        (index,) = ds.dataset(f"{self.path}/index", format="parquet").to_table().to_pylist()
        words = sorted(set(re.findall(_TERMS, self.query.lower())))
        table = ds.dataset(f"{self.path}/terms", format="parquet", partitioning="hive") if words else None
        rows = table.to_table(filter=ds.field("term").isin(words)).to_pylist() if words else []
        known = [(r["term"], r["bucket"], _rarity(index["n"], r["df"])) for r in sorted(rows, key=lambda r: r["term"])]
        if not known or (self.kind == "all" and len(known) < len(words)):
            return [Shard(0, [])]  # without any partition Spark would read one of its own
        return [Shard(s, known) for s in range(index["shards"]) if self.shards is None or s in self.shards] or [Shard(0, [])]

    def _terms(self, partition: Shard) -> list[Layers]:
        import pyarrow.dataset as ds

        out = []
        for term, bucket, rarity in partition.terms:
            try:
                rows = ds.dataset(f"{self.path}/postings/shard={partition.shard}/bucket={bucket}", format="parquet").to_table(["impact", "docs"], filter=ds.field("term") == term)
            except FileNotFoundError:
                rows = pa.table({"impact": [], "docs": []})
            out.append(Layers(rarity, [(i, np.array(d, np.int64)) for i, d in zip(rows["impact"].to_pylist(), rows["docs"].to_pylist(), strict=True)]))
        return out

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        found = self._terms(partition)
        if not found:
            return
        most = self.start * self.count
        if self.sort == "id" or self.ids is not None:
            most = 1 << 62  # not the highest scores are asked for
        if self.ids is not None:
            docs = np.array(sorted(self.ids), np.int64)
            each = [t.scores(docs) for t in found]
            total = sum(each)
            good = (total >= self.floor) & (np.all([e > 0 for e in each], axis=0) if self.kind == "all" else True)
            docs, scores, scored = docs[good], total[good], len(docs)
        else:
            docs, scores, scored = best(found, most, self.kind == "all", self.floor)
        n = len(docs)
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(scores, pa.int64()), pa.array([partition.shard] * n, pa.int32()), pa.array([scored] * n, pa.int64())], names=["doc_id", "score", "shard", "scored"])


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_search"

    def schema(self) -> str:
        return "doc_id long, score long, shard int, scored long"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def searcher(spark: SparkSession) -> None:
    """Register the source; filters are pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)


def search(spark: SparkSession, path: str, query: str, start: int = 1, count: int = 10, type: str = "any", sort: str = "relevance", least: int = 1) -> DataFrame:
    """(rank, doc_id, score): page ``start`` of the documents that match, ``count`` a page."""
    searcher(spark)
    found = spark.read.format("textloom_search").options(path=path, query=query, type=type, sort=sort, start=str(start), count=str(count)).load().where(F.col("score") >= least)
    order = [F.desc("score"), "doc_id"] if sort == "relevance" else ["doc_id"]
    page = found.orderBy(*order).limit(start * count)
    # a page has a bounded number of rows, so one task ranks them
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > (start - 1) * count).select("rank", "doc_id", "score")
