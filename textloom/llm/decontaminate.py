"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of n distinct shingles is contained in a document that has at least threshold % of them.  Items are partitioned
by size; an item of size n is indexed under its bottom-k MinHash sketch with k = n - ceil(t n) + 1 hashes of a fixed
order: shingles which fewer items share come first, equals by a random hash.  A document that contains the item misses at
most n - ceil(t n) of its shingles, so it has one of the k, whatever the order is: however long it is, the search loses
nothing, and a template that items share is in few sketches.  Documents which meet a sketch are verified against all
shingles of its items, a bounded number at a time, so neither all pairs of documents and items with a common shingle nor
the shingles of all candidates are ever in memory.

Items go in blocks of a bounded number of shingles, so what is broadcast is bounded however many items there are; with
more than one block each is searched and written before the next is sent.

Defined results: a null, empty or wordless item or document meets nothing; an item of fewer words than ``width`` is one
shingle, its whole sequence, found anywhere in a document; repeated rows give repeated rows; items with the same id are
items of their own; other columns are ignored by the search and kept by the filter; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import store
from textloom.llm.words import Words, distinct, mix, shingles_of, slices, words_of

_ORDER = np.uint64(0x452821E638D01377)


_PAIRS = 1 << 19  # candidates, and shingles of candidates, that are in memory at once


@dataclass
class SizePartition:
    """Items of one shingle width and of sizes in [2**s, 2**(s + 1)); postings (hash, item) of their sketches, sorted."""

    width: int
    sketch: np.ndarray
    sketch_item: np.ndarray


@dataclass
class Items:
    ids: np.ndarray
    sizes: np.ndarray
    parts: list[SizePartition]
    hashes: np.ndarray  # of each item after the other
    first: np.ndarray  # where an item's begin


def _build(ids: pa.Array, texts: pa.Array, width: int, threshold: int) -> Items:
    words = words_of(texts)
    n_words = np.diff(words.first)
    sizes, parts = np.zeros(len(ids), np.int64), []
    every, owners = [], []
    for w in range(1, width + 1):
        of = n_words >= width if w == width else n_words == w
        values, owner = distinct(*shingles_of(words, w))
        values, owner = values[of[owner]], owner[of[owner]]
        every.append(values), owners.append(owner)
        n = np.bincount(owner, minlength=len(ids))
        sizes[of] = n[of]
        _, at, shared = np.unique(values, return_inverse=True, return_counts=True)
        order = np.lexsort((mix(values ^ _ORDER), shared[at], owner))
        values, owner = values[order], owner[order]
        rank = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(n)])[owner]
        low = rank < (n - -(-n * threshold // 100) + 1)[owner]
        power = np.floor(np.log2(np.maximum(n, 1))).astype(int)
        for s in np.unique(power[of]) if of.any() else []:
            inside = low & (power[owner] == s)
            least = np.argsort(values[inside], kind="stable")
            parts.append(SizePartition(w, values[inside][least], owner[inside][least]))
    values, owner = np.concatenate(every), np.concatenate(owners)
    return Items(np.asarray(ids), sizes, parts, values[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(sizes)]))


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range of n numbers, one after another."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _chunks(n: np.ndarray) -> Iterator[slice]:
    """Slices of rows that have ``_PAIRS`` of something in all at most, or are one row."""
    total, begin = np.cumsum(n), 0
    while begin < len(n):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + _PAIRS, "right")))
        yield slice(begin, end)
        begin = end


class Documents:
    """Distinct shingles of one width of some documents."""

    def __init__(self, values: np.ndarray, owner: np.ndarray):
        values, owner = distinct(values, owner)
        self.known = np.unique(values)
        self.keys = owner * np.int64(len(self.known)) + np.searchsorted(self.known, values)  # sorted, as pairs are

    def have(self, docs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Whether each document has the value beside it."""
        at = np.searchsorted(self.known, values)
        ok = at < len(self.known)
        ok[ok] = self.known[at[ok]] == values[ok]
        keys = docs[ok] * np.int64(len(self.known)) + at[ok]
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        ok[ok] = self.keys[place] == keys
        return ok


def _verified(docs: Documents, pairs: np.ndarray, items: Items, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, shared shingles) of the candidates that hold; a pair is document * items + item."""
    n = items.sizes[pairs % len(items.ids)]
    for part in _chunks(n):
        p, size = pairs[part], n[part]
        which = _ranges(items.first[p % len(items.ids)], size)
        has = docs.have(np.repeat(p // len(items.ids), size), items.hashes[which])
        shared = np.add.reduceat(has, np.concatenate([[0], np.cumsum(size)[:-1]]), dtype=np.int64)
        ok = 100 * shared >= threshold * size
        yield p[ok], shared[ok]


def _search(words: Words, items: Items, threshold: int, once: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, shared shingles) of all containments; once: at least one of each document that has any."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = np.zeros(words.texts, bool)
    for w in sorted({p.width for p in items.parts}):
        values, owner = shingles_of(words, w)
        for part in (p for p in items.parts if p.width == w):
            # a small bitmap passes nearly all shingles by
            bitmap = np.zeros(1 << 20, bool)
            bitmap[part.sketch >> np.uint64(44)] = True
            maybe = np.flatnonzero(bitmap[values >> np.uint64(44)])
            own, of = distinct(values[maybe], owner[maybe])
            low, high = np.searchsorted(part.sketch, own, "left"), np.searchsorted(part.sketch, own, "right")
            hit = high > low
            low, n, of = low[hit], (high - low)[hit], of[hit]
            if not len(of):
                continue
            met = np.zeros(words.texts, bool)
            met[of] = True
            docs = Documents(values[met[owner]], owner[met[owner]])
            for rows in _chunks(n):
                which = part.sketch_item[_ranges(low[rows], n[rows])]
                of_each = np.repeat(of[rows], n[rows]).astype(np.int64)
                if once:
                    which, of_each = which[~done[of_each]], of_each[~done[of_each]]
                for pairs, shared in _verified(docs, np.unique(of_each * len(items.ids) + which), items, threshold):
                    if once:
                        done[pairs // len(items.ids)] = True
                    else:
                        found.append((pairs, shared))
    if once:
        return np.flatnonzero(done), np.empty(0, np.int64), np.empty(0, np.int64)
    if not found:
        return (np.empty(0, np.int64),) * 3
    pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_index=True)  # a document's candidates can fall into two chunks
    return pairs // len(items.ids), pairs % len(items.ids), np.concatenate([s for _, s in found])[at]


def _n_blocks(items: DataFrame, bound: int) -> int:
    return -(-2 * (items.agg(F.sum(F.length("text"))).first()[0] or 0) // bound)


def _blocks(items: DataFrame, width: int, threshold: int, n: int):
    """Broadcast indexes of the items, dealt into n blocks by a hash."""
    items = items.select(F.col("item_id"), "text").where(F.length("text") > 0)
    for i in range(n):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow()
        ids, texts = (got.column(c).combine_chunks() for c in ("item_id", "text"))
        ids, texts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, texts))
        if len(ids):
            yield items.sparkSession.sparkContext.broadcast(_build(ids, texts, width, threshold))


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 75, bound: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): every item that a document contains."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    items = items.withColumn("item_id", F.col("item_id").cast("long"))
    out = "doc_id long, item_id long, shared long, item_shingles long, containment double"

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                d, i, shared = _search(words_of(part.column("text")), index.value, threshold)
                if len(d):
                    n = index.value.sizes[i]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(index.value.ids[i], pa.int64()), pa.array(shared, pa.int64()), pa.array(n, pa.int64()), pa.array(shared / n)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

        return run

    parts, n = [], _n_blocks(items, bound)
    for index in _blocks(items, width, threshold, n):
        found = docs.mapInArrow(search(index), out)
        if n > 1:
            found = store.written(found, "contaminated")
            index.destroy()
        parts.append(found)
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], out)


def clean(docs: DataFrame, items: DataFrame, width: int = 5, threshold: int = 75, bound: int = 16_000_000) -> DataFrame:
    """The rows of docs, all columns, that contain no item. No shuffle; one pass over docs for each block of items."""
    items = items.withColumn("item_id", F.col("item_id").cast("long"))

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                d, _, _ = _search(words_of(part.column("text")), index.value, threshold, once=True)
                ok = np.ones(part.num_rows, bool)
                ok[d] = False
                yield part.filter(pa.array(ok))

        return run

    n = _n_blocks(items, bound)
    for index in _blocks(items, width, threshold, n):
        docs = docs.mapInArrow(keep(index), docs.schema)
        if n > 1:
            docs = store.written(docs, "clean")
            index.destroy()
    return docs
