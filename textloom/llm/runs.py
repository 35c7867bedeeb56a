"""Periodic runs of words in a text: every lag is compared with the text, and stretches of equal words are run-length coded.

A run is a longest stretch of consecutive words with smallest period q (words q apart are the same) and at least
``max(shortest, exponent * q)`` words, so lags up to n / exponent are all there are.  At lag q a run shows as a stretch of
at least ``need = max(shortest, exponent * q) - q`` equal comparisons.  The texts of a batch lie one after another, longest
first, and are compared with their shift in one numpy operation for each lag.  Comparisons are first made at every
``need // 8``-th word: a stretch of ``need`` covers eight of these in a row, so a text without eight in a row has no run of
that period and isn't looked at further; the others are compared in full at that lag.  All lags of a text of n words
take about n log n comparisons this way, and no run is missed.

A stretch of period q may have a smaller one.  As it has q twice, that one divides q, and shows in its first q words.  It
is then noted, and explains all later lags inside, so a text that repeats itself all along isn't compared anew for each.

Texts of ``long_text`` bytes or more are dealt as (text, range of lags) rows over the cluster, each distinct one once;
lags need nothing of each other.  Their runs are gathered by text: at most as many as it has words.

Defined results: a null or empty text has no runs and collapses to an empty text; repeated rows are done each; other
columns are kept, ``runs`` and ``collapsed`` are replaced; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.words import slices, words_of

RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
_LAGS = 1 << 18


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _smallest(x: np.ndarray, q: int) -> int:
    """The smallest period of a stretch that begins with the q words x and has period q at least twice."""
    least = q
    for p in _primes(q):
        while least % p == 0 and np.array_equal(x[: q - least // p], x[least // p :]):
            least //= p
    return least


def _stretches(equal: np.ndarray, need: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of stretches of at least ``need`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    wide = stops - starts >= need
    yield from zip(starts[wide].tolist(), stops[wide].tolist(), strict=True)


def scan(hashes: np.ndarray, first: np.ndarray, exponent: int, shortest: int, lo: int = 1, hi: int | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text the runs (start, length, period) with lo <= period < hi, sorted."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    x = np.concatenate([hashes[first[i] : first[i + 1]] for i in order]) if len(order) else hashes
    small = x.astype(np.uint32)  # equal words have equal halves; what passes is compared whole
    found: list[list[tuple[int, int, int]]] = [[] for _ in n]
    known: dict[int, list[tuple[int, int, int]]] = {}
    last = (int(sizes[0]) if len(sizes) else 0) // exponent
    for q in range(lo, min(last + 1, hi or last + 1)):
        most = max(shortest, exponent * q)
        end = int(at[np.searchsorted(-sizes, -most, "right")])  # of the texts that are long enough
        need = most - q
        step = max(1, need // 8)
        row, width = small[: end - q : step] == small[q:end:step], 1
        while width * 2 <= need // step and len(row):
            row = row[:-width] & row[width:]
            width *= 2
            if not row.any():
                break
        hits = np.flatnonzero(row) * step
        if not len(hits):
            continue
        of = np.searchsorted(at, hits, "right") - 1
        for k in np.unique(of).tolist():
            begin, size = int(at[k]), int(sizes[k])
            here = hits[of == k] - begin
            for s, e, g in known.get(k, ()):
                if q % g == 0 and e - s >= q:
                    here = here[(here < s) | (here + q > e)]
            if not len(here) or size < most:
                continue
            text = x[begin : begin + size]
            for s, e in _stretches(text[: size - q] == text[q:], need):
                g = _smallest(text[s : s + q], q)
                if g == q:
                    found[order[k]].append((s, e + q - s, q))
                known.setdefault(k, []).append((s, e + q, g))
    for f in found:
        f.sort()
    return found


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    r = np.array(runs, np.int64)
    np.add.at(edge, r[:, 0] + r[:, 2], 1)
    np.add.at(edge, r[:, 0] + r[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def _lists(runs: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_ARROW_RUN)))


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def find_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, long_text: int = 4_000_000) -> DataFrame:
    """docs with ``runs``, sorted by start and period, and ``collapsed``: the words that no run repeats, joined by one space.

    A word is repeated if it lies in a run, after that run's first ``period`` words.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run repeats its period: exponent and shortest are 2 at least")
    docs = docs.drop("runs", "collapsed")
    out = T.StructType([*docs.schema, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    key, lo, hi = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in ("key", "lo", "hi"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            w = words_of(part.column("text"), lower=False)
            runs = scan(w.hashes, w.first, exponent, shortest)
            texts = [_collapse(x.split(), r) for x, r in zip(_texts(part), runs, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(runs), pa.array(texts, pa.binary()).cast(pa.string())], names=[f.name for f in out])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1):
            w = words_of(part.column("text"), lower=False)
            (runs,) = scan(w.hashes, w.first, exponent, shortest, part.column(lo)[0].as_py(), part.column(hi)[0].as_py())
            if runs:
                yield pa.RecordBatch.from_arrays([pa.array([part.column(key)[0].as_py()] * len(runs)), pa.array([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], _ARROW_RUN)], names=[key, "run"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1):
            runs = [tuple(r.values()) for r in part.column("runs")[0].as_py()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_collapse(_texts(part)[0].split(), runs)], pa.binary()).cast(pa.string())], names=[f.name for f in out])

    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) >= long_text
    short, long = docs.where(~is_long), docs.where(is_long).withColumn(key, F.sha2("text", 256))
    texts = long.groupBy(key).agg(F.first("text").alias("text"))
    # powers of two take about the same time each; above a bound, so many lags at a time
    most = F.floor((F.octet_length("text") + 1) / (2 * exponent))
    begins = F.expr("transform(sequence(0, 40), i -> shiftleft(1L, i))")
    starts = F.flatten(F.transform(F.filter(begins, lambda b: b <= most), lambda b: F.sequence(b, F.least(2 * b - 1, most), F.lit(_LAGS).cast("long"))))
    dealt = texts.withColumn(lo, F.explode(starts)).withColumn(hi, F.least(F.col(lo) + _LAGS, F.expr(f"shiftleft(1L, cast(floor(log2(`{lo}`)) as int) + 1)")))
    dealt = dealt.repartition(key, lo).mapInArrow(ranges, T.StructType([T.StructField(key, T.StringType()), T.StructField("run", RUN)]))
    runs = dealt.groupBy(key).agg(F.array_sort(F.collect_list("run")).alias("runs"))
    joined = long.join(runs, key, "left").withColumn("runs", F.coalesce("runs", F.array().cast(T.ArrayType(RUN)))).select(*docs.columns, "runs")
    return short.mapInArrow(whole, out).unionByName(joined.mapInArrow(finish, out))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equals the first by start, then period; null if there is none."""
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def digest(runs: Column) -> Column:
    lines = F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)
