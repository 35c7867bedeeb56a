"""Exact top-k search by a three-phase uniform threshold.

A vector is cut into ``groups`` groups of dimensions, each of which ranks all rows by its own part of the inner product.
1. Every task gathers, for each query and each group, its k best local entries; only these are summed up in full.  The
   k-th best of all these sums is a safe cutoff: at least k rows reach it.
2. The cutoff T is sent out.  An entry is sufficient in a group if its part there reaches T / groups; a row with a sum of T
   is so in some group, negative parts or not.  Parts that aren't are below T / groups, which bounds the sum from above:
   entries whose bound is below T are passed over unsummed.
3. What remains has its missing parts resolved exactly, where its vector is; a task returns its k best for each query, and a
   window ranks them.

Scores are integers (components floor(scale * x)), ties go to the smaller id.  Queries go in blocks of a bounded number of
bytes, so what is broadcast (a block, its cutoffs) is bounded whatever the table holds; each block is matched with all rows,
and its broadcasts go before the next one's come.

Defined results: vectors that are null, empty, hold null or non-finite components, or have a null id take no part; a row
isn't its own query's candidate, by id; repeated rows are candidates of their own; rows that share a query's id are one
query, whose entries are those of all its rows; vectors of another length than a query have no score with it; other columns
are ignored; an empty table gives no row.  Sums are taken in doubles while they stay below 2**53, else in 64-bit integers; where
these could overflow, an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.store import written

ROWS = "vec_id long, v array<long>"
LOCAL = "query_id long, vec_id long, score long"
_ROWS = 2048  # rows at a time in a task
_QUERIES = 512  # queries at a time in a task
_KEPT = 1 << 20  # entries that a task holds before it keeps only the best


def integers(table: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): valid rows with components floor(scale * x), x as double."""
    ok = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows of one length, at most ``_ROWS`` at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            v = part.column(1)
            ids, sizes = part.column(0).to_numpy(), v.value_lengths().to_numpy()
            flat, at = v.flatten().to_numpy().astype(kind), np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                which = np.flatnonzero(sizes == d)
                yield ids[which], flat[at[which][:, None] + np.arange(d)]


def _cuts(d: int, groups: int) -> list[slice]:
    edges = np.linspace(0, d, min(groups, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _Best:
    """The k best entries of each query id, by score and then smaller id."""

    def __init__(self, k: int):
        self.k, self.held, self.n = k, [], 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((query, ids, score.astype(np.int64)))
        self.n += len(query)
        if self.n > _KEPT:
            self.shrink()

    def shrink(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        new = np.ones(len(query), bool)
        new[1:] = query[1:] != query[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
        keep = np.arange(len(query)) - begin < self.k
        self.held, self.n = [(query[keep], ids[keep], score[keep])], 0  # counts anew, so that this is done once in so many entries

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.shrink()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in self.held[0]], names=["query_id", "vec_id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, groups: int = 4, block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, v) against rows (vec_id, v), both from ``integers``."""
    spark, out = rows.sparkSession, "query_id long, rank int, vec_id long, score long"
    largest = lambda df: df.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("decimal(20,0)"))))), F.sum(F.size("v")), F.max(F.size("v"))).first()
    (most, cells, longest), (other, _, _) = largest(queries), largest(rows)
    if not cells or other is None:
        return spark.createDataFrame([], out)
    bound = int(most) * int(other) * longest
    if bound >= 2**63:
        raise ArithmeticError("scores may not fit in 64 bits")
    blocks = -(-2 * 8 * cells // block_bytes)  # half full on average, so that none of them grows past its bytes
    parts = [_one_block(rows, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k, groups, np.float64 if bound < 2**53 else np.int64) for i in range(blocks)]
    return reduce(DataFrame.unionAll, parts)


def _one_block(rows: DataFrame, queries: DataFrame, k: int, groups: int, kind: type) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    got = queries.toArrow()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for chunk in got.combine_chunks().to_batches():
        for d in np.unique(chunk.column("v").value_lengths().to_numpy()):
            part = chunk.filter(pa.array(chunk.column("v").value_lengths().to_numpy() == d))
            own = part.column("vec_id").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, d)
            by_size[d] = tuple(np.concatenate(x) for x in zip(by_size[d], own, strict=True)) if d in by_size else own
    sent = sc.broadcast(by_size)

    def dealt(batches: Iterator[pa.RecordBatch]):
        """Queries and rows of the same length, some of each at a time."""
        for row_ids, x in _blocks(batches, kind):
            query_ids, q = sent.value.get(x.shape[1], (np.empty(0, np.int64), None))
            for i in range(0, len(query_ids), _QUERIES):
                yield query_ids[i : i + _QUERIES], q[i : i + _QUERIES].astype(kind), row_ids, x, _cuts(x.shape[1], groups)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for query_ids, q, row_ids, x, cuts in dealt(batches):
            few = min(k + 1, len(row_ids))  # one may be the query itself
            listed = np.concatenate([np.argpartition(q[:, c] @ x[:, c].T, len(row_ids) - few, axis=1)[:, len(row_ids) - few :] for c in cuts], axis=1)
            flat = np.unique(np.arange(len(q))[:, None] * len(x) + listed)
            a, b = flat // len(x), flat % len(x)
            other = query_ids[a] != row_ids[b]
            a, b = a[other], b[other]
            best.add(query_ids[a], row_ids[b], np.einsum("ij,ij->i", q[a], x[b]))
        yield from best.rows()

    lists = rows.mapInArrow(first, LOCAL)
    kth = lists.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") == k).select("query_id", "score")
    cutoff = sc.broadcast({r["query_id"]: r["score"] for r in kth.collect()})  # at most one number a query of the block

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for query_ids, q, row_ids, x, cuts in dealt(batches):
            m = len(cuts)
            t = np.array([cutoff.value.get(i, -np.inf) for i in query_ids.tolist()], np.float64)[:, None]
            known, missing = np.zeros((len(q), len(x)), kind), np.zeros((len(q), len(x)), np.int8)
            slack = 1 + np.abs(t) * 1e-15  # doubles may round T / m; slack only lets more entries pass
            parts = []
            for c in cuts:
                part = q[:, c] @ x[:, c].T
                enough = part >= t / m - slack
                known += np.where(enough, part, 0)
                missing += ~enough
                parts.append(enough)
            left = (missing < m) & (known + missing * np.where(np.isfinite(t), t / m, 0) >= t - m * slack)
            a, b = np.nonzero(left & (query_ids[:, None] != row_ids[None, :]))
            score = known[a, b]
            for c, enough in zip(cuts, parts, strict=True):
                open_ = np.flatnonzero(~enough[a, b])
                score[open_] += np.einsum("ij,ij->i", q[a[open_]][:, c], x[b[open_]][:, c])
            reach = score >= (t - slack)[a, 0]
            best.add(query_ids[a[reach]], row_ids[b[reach]], score[reach])
        yield from best.rows()

    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = written(rows.mapInArrow(second, LOCAL).withColumn("rank", n).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top-k")
    sent.destroy(), cutoff.destroy()
    return found
