"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(theta_j - w x) with weights w shared by all grades over hashed text features and ordered
thresholds theta.  It gives a document's expected grade and its tail probability P(grade >= g), by which it is selected.

Grades here: 0 rated toxic, 1 rated of low quality, 2 rated good and not toxic.  x holds which hashed words, beginnings
and ends of words a whole text has, binned shares of capitals, symbols and repeated words, and its binned length.  Toxic is
the lowest grade: insults add up, and what adds up may go as low as it likes there.

Weights are held at or below 0 (evidence counts against a document; short ones aren't rejected for want of evidence), and only
features whose share differs between grades by ``least`` standard errors take part, as many as chance gives one or two of
2**BITS: so a word that tells is found in small samples too.

The model is fitted on at most ``per_grade`` rated documents of each grade (those with the smallest hash of doc_id), a
documented bound; every document is scored.  Weights stay below 2**BITS numbers, so they can be broadcast.

Defined results: a null or empty text has only binned features; a document rated twice counts as two; ratings that are null
or without a document are ignored; with fewer than two grades rated nothing is rejected; other columns are kept by the
filter; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.store import written
from textloom.llm.words import _bytes, mix, slices, words_of

BITS = 18
_PARTS = 32  # in which ratings are ranked first
_CLASS = np.zeros(256, np.uint8)  # 1 letter or digit, 2 capital, 3 space, 4 symbol
_CLASS[33:127] = 4
_CLASS[48:58] = _CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 1


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, as (feature, text), sorted by text."""
    words = words_of(texts)
    owner, n = words.owner(), words.texts
    length = words.ends - words.starts
    data = np.concatenate([words.data, np.zeros(6, np.uint8)]).astype(np.uint64)

    def some(at: np.ndarray, size: np.ndarray, most: int, salt: int) -> np.ndarray:
        h = np.full(len(at), salt, np.uint64)
        for i in range(most):
            h = h * np.uint64(257) + np.where(i < size, data[at + i] + np.uint64(1), np.uint64(0))
        return mix(h)

    last = np.where(_CLASS[words.data[words.ends - 1]] == 4, 1, 0) if len(length) else length
    plain = length - np.where(length > 1, last, 0)  # without a final symbol
    end = words.starts + plain
    four, six = np.minimum(length, 4), np.minimum(plain, 6)
    middle = np.minimum(np.maximum(plain - 6, 0), 6)
    own = mix(some(words.starts, six, 6, 4) + mix(some(end - middle, middle, 6, 5) + plain.astype(np.uint64)))
    hashed = [own, some(words.starts, np.minimum(plain, 4), 4, 1), some(words.starts, six, 6, 3), some(words.ends - four, four, 4, 2)]
    raw, at = _bytes(texts)
    kinds = _CLASS[raw]
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[at])
    letters, capitals, symbols = count(1), count(2), count(4)
    combined = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (words.hashes >> np.uint64(24)))
    different = np.bincount((combined >> np.uint64(40)).astype(np.int64), minlength=n)
    total = np.maximum(np.diff(words.first), 1)
    bins = [capitals / np.maximum(letters + capitals, 1), symbols / np.maximum(letters + capitals + symbols, 1), (different / total) ** np.where(total > 1, 0.5, 1)]
    for i, share in enumerate(bins):
        hashed.append(mix(np.minimum(share * 16, 15).astype(np.uint64) + np.uint64(1000 * (i + 1))))
    hashed.append(mix(np.uint64(9000) + np.floor(2 * np.log2(total)).astype(np.uint64)))  # an offset for each length, as sums over words grow with it
    key = np.concatenate([(o.astype(np.uint64) << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)) for h, o in zip(hashed, [owner] * 4 + [np.arange(n)] * 4, strict=True)])
    key = np.unique(key)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def _telling(counts: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which features are in documents of one grade more or less often than in the others', by ``least`` standard errors.

    counts has, for each grade, in how many documents each feature is; sizes the documents of each grade.
    """
    df, n = counts.sum(axis=0), sizes.sum()
    p = df / n
    keep = np.zeros(len(df), bool)
    for inside, m in zip(counts, sizes, strict=True):
        if 0 < m < n:
            spread = np.sqrt(p * (1 - p) * (1 / m + 1 / (n - m))) + 1e-9
            keep |= (np.abs(inside / m - (df - inside) / (n - m)) > least * spread) & (df >= 3)
    return keep


def fit(x: np.ndarray, owner: np.ndarray, grade: np.ndarray, df: np.ndarray, penalty: float = 2e-4, steps: int = 250) -> Model:
    """Penalised maximum likelihood over telling features x scaled by log(n / df), by full-batch Adam with steps that get smaller. Deterministic."""
    k = int(grade.max())
    scale = np.where(df > 0, np.log(len(grade) / np.maximum(df, 1)) / 3, 0)
    weight = np.bincount(grade, minlength=k + 1).clip(1)[grade] ** -0.5
    weight /= weight.sum()
    w, gap = np.zeros(1 << BITS), np.array([-1.0] + [0.5] * (k - 1))  # thresholds: the first, then logs of the gaps
    m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))
        score = np.bincount(owner, (w * scale).astype(np.float32)[x], len(grade))
        low = np.concatenate([[-np.inf], theta])[grade] - score
        high = np.concatenate([theta, [np.inf]])[grade] - score
        a, b = (1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (low, high))
        a, b = np.where(grade == 0, 0, a), np.where(grade == k, 1, b)
        p = np.maximum(b - a, 1e-9)
        da, db = -a * (1 - a) / p * weight, b * (1 - b) / p * weight  # of log p by the lower and the upper threshold
        theta_grad = np.array([db[grade == j].sum() + da[grade == j + 1].sum() for j in range(k)])
        grad_w = -scale * np.bincount(x, -(da + db).astype(np.float32)[owner], len(w)) + penalty * w
        suffix = np.cumsum(theta_grad[::-1])[::-1]
        grad_gap = -suffix * np.concatenate([[1], np.exp(gap[1:])])
        g = np.concatenate([grad_w, grad_gap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.075 * (1 + np.cos(np.pi * step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, gap = np.minimum(w - move[:-k], 0), gap - move[-k:]
    return Model((w * scale).astype(np.float32), np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])])))


def train(docs: DataFrame, labels: DataFrame, per_grade: int = 4000, least: float = 4.5) -> Model:
    """Fit on a bounded sample of the rated documents; only counts and their telling features come to the driver."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    known = labels.select("doc_id", grade.alias("grade")).where("grade is not null")
    order = F.xxhash64("doc_id", F.lit(3))
    # the first of each part come first, so that no task ranks all ratings
    ranked = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("grade", *by).orderBy(order, "doc_id"))).where(F.col("n") <= per_grade)
    some = ranked(ranked(known.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(_PARTS))), "part"))
    sample = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", "grade")), "doc_id").select("grade", "text")  # at most 3 * per_grade rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, owner = features(part.column("text"))
            at = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32)))], names=["grade", "x"])

    rated = written(sample.mapInArrow(run, "grade int, x array<int>"), "rated")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << BITS), np.int64)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("x")), 0).to_numpy()
            g = np.repeat(batch.column("grade").to_numpy(), sizes)
            total += np.bincount((g.astype(np.int64) << BITS) + batch.column("x").flatten().to_numpy(), minlength=3 << BITS).reshape(3, -1)
        g, f = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(total[g, f])], names=["grade", "feature", "n"])

    counts, sizes = np.zeros((3, 1 << BITS), np.int64), np.zeros(3, np.int64)
    for r in rated.groupBy("grade").count().collect():  # three rows at most
        sizes[r["grade"]] = r["count"]
    if np.count_nonzero(sizes) < 2:
        return Model(np.zeros(1 << BITS, np.float32), np.full(2, -50.0))
    for batch in rated.mapInArrow(count, "grade int, feature int, n long").groupBy("grade", "feature").agg(F.sum("n").alias("n")).toArrow().to_batches():  # 3 * 2**BITS rows at most
        counts[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
    levels = np.flatnonzero(sizes)
    keep = _telling(counts[levels], sizes[levels], least)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(keep).tobytes())

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(sent.value, np.uint8)).astype(bool)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy()
            at = np.concatenate([[0], np.cumsum(mask[x])])[np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("x")).to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x[mask[x]]))], names=["grade", "x"])

    # in a fixed order, so that sums don't depend on how tasks ended
    got = rated.mapInArrow(telling, "grade int, x array<int>").orderBy("grade", F.xxhash64("x")).toArrow()
    grades = np.concatenate([c.to_numpy() for c in got.column("grade").chunks])
    flat = np.concatenate([c.flatten().to_numpy() for c in got.column("x").chunks])
    size = np.concatenate([pc.list_value_length(c).to_numpy() for c in got.column("x").chunks])
    del got
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    model = fit(flat, owner, np.searchsorted(levels, grades), np.where(keep, counts.sum(axis=0), 0))
    if len(levels) < 3 or levels[-1] < 2:  # a grade nobody gave: its threshold falls together with its neighbour's
        at = [model.thresholds[np.searchsorted(levels, g) - 1] if 0 < np.searchsorted(levels, g) < len(levels) else (-50.0 if np.searchsorted(levels, g) == 0 else 50.0) for g in (1, 2)]
        return Model(model.weights, np.array(at))
    return model


def _scored(sent, extra: bool, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, owner = features(part.column("text"))
            tails = sent.value.tails(np.bincount(owner, sent.value.weights[x], part.num_rows))
            if extra:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= least)], names=["doc_id", "expected_grade", "p_above_low", "p_good", "keep"])
            else:
                yield part.filter(pc.greater_equal(pa.array(tails[:, -1]), least))

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_above_low, p_good, keep) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = "doc_id long, expected_grade double, p_above_low double, p_good double, keep boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(sent, True, least), out)


def select(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose tail probability P(grade = good) is at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_scored(sent, False, least), docs.schema)
