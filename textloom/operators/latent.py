"""Latent semantic analysis over all terms: a truncated singular value decomposition by a randomised range finder.

The matrix stays (doc_id, term, w) rows.  Tall matrices, of documents or terms by some ``k + extra`` columns, are rows of
arrays, made by joins of these with the weights and sums by key.  They are made orthonormal in blocks: each partition adds up
its part of the small matrix of inner products, these are summed in two steps, and its Cholesky factor is applied to the
rows.  The driver holds matrices of k + extra rows and columns only, however many documents and terms there are.

The start is a fixed pseudo-random number of each term and column, so results are the same each time.  Rounds go on until no
singular value changes by ``tolerance`` of the first; if ``rounds`` are over before, ``converged`` is false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lineage


def _rows(b: pa.RecordBatch) -> np.ndarray:
    x = b.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _gram(tall: DataFrame) -> np.ndarray:
    """Inner products of the columns: sums of a few partitions first, then of these."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _rows(b)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_rows(b).sum(axis=0) for b in batches if b.num_rows), 0)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["x"])

    rows = tall.select("x").mapInArrow(part, "x array<double>").repartition(8).mapInArrow(add, "x array<double>").collect()
    total = np.sum([r.x for r in rows], axis=0) if rows else np.zeros(1)
    n = int(round(len(total) ** 0.5))
    g = total.reshape(n, n)
    return (g + g.T) / 2


def _times(tall: DataFrame, small: np.ndarray) -> DataFrame:
    """The rows of a tall matrix times a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b) @ small if b.num_rows else np.empty((0, small.shape[1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * small.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), lists], names=["key", "x"])

    return tall.select("key", "x").mapInArrow(run, tall.select("key", "x").schema)


def _factor(g: np.ndarray) -> np.ndarray:
    """What makes columns with these inner products orthonormal; columns that others give already are left out."""
    values, vectors = np.linalg.eigh(g)
    good = values > values.max(initial=0.0) * 1e-13
    return vectors[:, good] / np.sqrt(values[good])


def _orthonormal(tall: DataFrame) -> DataFrame:
    """Twice, as once loses digits where columns are nearly parallel. Rows are multiplied where they are read, not stored anew."""
    for _ in range(2):
        tall = _times(tall, _factor(_gram(tall)))
    return tall


def _product(weights: DataFrame, by: str, to: str, tall: DataFrame, columns: int) -> DataFrame:
    """The matrix, or its transpose, times a tall matrix: (key, x) by ``to``."""
    joined = weights.select(F.col(by).alias("key"), F.col(to).alias("to"), "w").join(tall, "key")
    sums = joined.groupBy("to").agg(*(F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"x{i}") for i in range(columns)))
    return sums.select(F.col("to").alias("key"), F.array(*(f"x{i}" for i in range(columns))).alias("x"))


def _single(w: DataFrame) -> DataFrame:
    """(term, doc_id, length, of, share) of terms that one document has, which are parallel columns; ``of`` is what stands for all of a document's."""
    one = w.groupBy("term").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id"), F.first("w").alias("w")).where("n = 1")
    length = one.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return one.join(length, "doc_id").select("term", "doc_id", "length", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("of"), (F.col("w") / F.col("length")).alias("share"))


def _merged(w: DataFrame, single: DataFrame) -> DataFrame:
    """Weights with the same singular values and document vectors: a column for all terms that only one document has."""
    rest = w.join(single.select("term"), "term", "left_anti").select("doc_id", F.concat(F.lit("t"), "term").alias("term"), "w")
    return rest.unionAll(single.select("doc_id", F.col("of").alias("term"), F.col("length").alias("w")).distinct())


def _parted(concepts: DataFrame, single: DataFrame) -> DataFrame:
    """Concepts of all terms: of a merged column each term has its share."""
    own = concepts.where(F.col("key").startswith("t")).select(F.substr("key", F.lit(2)).alias("key"), "x")
    parts = single.join(concepts.where(F.col("key").startswith("d")).withColumnRenamed("key", "of"), "of")
    return own.unionAll(parts.select(F.col("term").alias("key"), F.transform("x", lambda v: v * F.col("share")).alias("x")))


def _noise(key: str, i: int) -> Column:
    """A normal number that follows from a key and a column."""
    uniform = lambda s: (F.pmod(F.xxhash64(key, F.lit(i), F.lit(s)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2))


def _start(terms: DataFrame, single: DataFrame, columns: int) -> DataFrame:
    """Noise of each term; of a merged column what its terms' noise comes to, so all goes on as if they were apart."""
    own = terms.where(F.col("key").startswith("t")).select("key", F.substr("key", F.lit(2)).alias("term"))
    apart = own.select("key", F.array(*(_noise("term", i) for i in range(columns))).alias("x"))
    sums = single.groupBy(F.col("of").alias("key")).agg(*(F.sum(F.col("share") * _noise("term", i)).alias(f"x{i}") for i in range(columns)))
    return apart.unionAll(sums.select("key", F.array(*(f"x{i}" for i in range(columns))).alias("x")))


class LatentSemantics:
    """Singular values, document vectors (doc_id, x) and concepts (term, x) of weights (doc_id, term, w), largest first.

    As a vector's sign says nothing, the largest part of each concept is positive.  ``absolute`` gives all parts as they are
    without their sign.  Fewer than ``k`` values are returned if the matrix has a lower rank.
    """

    def __init__(self, k: int = 10, extra: int = 10, rounds: int = 30, tolerance: float = 1e-9, absolute: bool = False):
        self.k, self.extra, self.rounds, self.tolerance, self.absolute = k, extra, rounds, tolerance, absolute

    def fit(self, weights: DataFrame) -> LatentSemantics:
        w = weights.where("w <> 0").select("doc_id", "term", F.col("w").cast("double").alias("w"))
        spark = weights.sparkSession
        tables = lineage.Scratch(spark, "latent")
        w = tables.put("weights", w)
        single = tables.put("single", _single(w))
        w = tables.put("merged", _merged(w, single))
        tables.drop("weights")
        columns = self.k + self.extra
        terms = w.select(F.col("term").alias("key")).distinct()
        tall = _start(terms, single, columns)
        self.sigma, self.converged = np.zeros(0), False
        if terms.isEmpty():
            self.documents = weights.select("doc_id").limit(0).withColumn("x", F.array().cast("array<double>"))
            self.concepts = weights.select("term").limit(0).withColumn("x", F.array().cast("array<double>"))
            self.converged = True
            return self
        for _ in range(self.rounds):
            q = _orthonormal(tables.put("left", _product(w, "term", "doc_id", tall, columns)))
            columns = len(q.first().x)
            right = tables.put("right", _product(w, "doc_id", "term", q, columns))
            values, vectors = np.linalg.eigh(_gram(right))
            order = np.argsort(-values)[: self.k]
            sigma = np.sqrt(np.maximum(values[order], 0))
            before, self.sigma = self.sigma, sigma
            if len(before) == len(sigma) and np.all(np.abs(before - sigma) <= self.tolerance * max(sigma.max(initial=0.0), 1e-300)):
                self.converged = True
                break
            tall = _orthonormal(right)
            columns = len(tall.first().x)
        good = self.sigma > self.sigma.max(initial=0.0) * 1e-7
        self.sigma, order = self.sigma[good], order[good]
        small = vectors[:, order]
        concepts = tables.put("concepts", _parted(_times(right, small / self.sigma), single))
        for name in ("right", "merged", "single"):
            tables.drop(name)
        signs = np.ones(len(order)) if self.absolute else self._signs(concepts, len(order))
        finish = (lambda x: F.transform(x, F.abs)) if self.absolute else (lambda x: x)
        self.concepts = _times(concepts, np.diag(signs)).select(F.col("key").alias("term"), finish(F.col("x")).alias("x"))
        self.documents = _times(q, small * signs).select(F.col("key").alias("doc_id"), finish(F.col("x")).alias("x"))
        return self

    @staticmethod
    def _signs(concepts: DataFrame, n: int) -> np.ndarray:
        x = [F.get("x", F.lit(i)) for i in range(n)]
        largest = concepts.agg(*(F.max_by(x[i], F.struct(F.round(F.abs(x[i]), 9), "key")).alias(f"c{i}") for i in range(n))).first()
        return np.array([1.0 if v >= 0 else -1.0 for v in largest])

    def transform(self, weights: DataFrame) -> DataFrame:
        """(doc_id, x) of other documents: their terms' concepts by weight, each divided by its singular value."""
        n = len(self.sigma)
        if not n:
            return weights.select("doc_id").limit(0).withColumn("x", F.array().cast("array<double>"))
        out = _product(weights.select("doc_id", "term", "w"), "term", "doc_id", self.concepts.select(F.col("term").alias("key"), "x"), n)
        return _times(out, np.diag(1 / self.sigma)).select(F.col("key").alias("doc_id"), "x")
