"""Phrase collocations: phrases far more frequent than their halves, counted by a minimal perfect hash over candidates.

Texts are cut into pieces and words; everything is counted for each language.  A phrase is known by a 64-bit key of its
language and words.  In passes over the corpus:

1. Buckets of words are counted: mappers count hashed keys in numpy arrays, which are summed in a tree.  A word with
   ``least`` occurrences lies in a bucket of at least as many.  What passes is written as one array of keys a slice, with
   breaks where a word can't be part of a candidate: later passes read this, not the texts.
2. For each length of 2 to 5, buckets of the phrases whose two parts of one word less passed are counted likewise.  What
   passes at its length is Apriori-safe: no frequent phrase is lost, few others remain.
3. The distinct keys that passed are dealt into blocks, each of which gets a minimal perfect hash with its keys stored by
   slot.  Mappers look keys up, verify them against the stored ones and ``bincount`` slots; arrays are summed in a tree.
   The hashes that one pass has in memory keep to ``bound`` bytes; further blocks take further passes over the keys.
4. Counts of both sides of each cut of a frequent phrase are read by slot.

Bitmaps of buckets have 2**26 bits at most (8 MB for each length).  Beyond some tens of GB of text with a fixed ``least``
they let more through; results stay the same, with more candidates to count.  A 64-bit key of another phrase would be
taken for a candidate's: its chance is candidates * phrases / 2**64.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; other columns are
ignored; an empty table or one without frequent phrases gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import store
from textloom.llm.words import mix, slices, words_of

LONGEST = 5
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[0x20, 0x09, 10, 11, 12, 13, *b".,;:!?"]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)
_CHUNK = 16  # bits: an array is summed in chunks of 2**16
_FAN = 8
SUMS = "chunk long, salt int, at binary, n binary"


def _language(name: str) -> np.uint64:
    words = words_of(pa.array([f"lang={name}"]), lower=False, space=np.zeros(256, bool))
    return words.hashes[0]


def _longer(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of phrases with one more word."""
    return mix(keys * _STEP + word) | _ONE  # never 0, which is a break


# ---- arrays that are summed in a tree


class Sparse:
    """Counts by index, of which a task sends what isn't zero; more than ``top`` counts as ``top``."""

    def __init__(self, size: int, top: int):
        self.top = top
        self.n = np.zeros(size, np.min_scalar_type(top))

    def add(self, index: np.ndarray) -> None:
        if len(index):
            at, n = np.unique(index, return_counts=True)
            self.n[at] = np.minimum(self.n[at].astype(np.int64) + n, self.top).astype(self.n.dtype)

    def rows(self, base: int = 0) -> Iterator[pa.RecordBatch]:
        """Rows of ``SUMS``; chunks are numbered from ``base``."""
        salt = TaskContext.get().partitionId() % _FAN
        for chunk in range(-(-len(self.n) >> _CHUNK)):
            part = self.n[chunk << _CHUNK : (chunk + 1) << _CHUNK]
            if part.any():
                yield _row(base + chunk, salt, part)


def _row(chunk: int, salt: int, part: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(part)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([salt], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], names=["chunk", "salt", "at", "n"])


def _indices(chunk: int, at: bytes) -> np.ndarray:
    """Indices of a whole array, of those in a chunk."""
    return np.frombuffer(at, np.uint16).astype(np.int64) + (chunk << _CHUNK)


def _summed(rows: DataFrame, top: int, least: int = 0) -> DataFrame:
    """Rows of ``SUMS``, one a chunk: sums of a part of the tasks, then of those. Only one chunk is in memory.

    With ``least``, ``n`` is a bit for each index of the chunk instead: whether its sum is so high.
    """
    kind = np.min_scalar_type(top)

    def bits(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        packed = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([0], pa.int32()), pa.array([b""], pa.binary()), pa.array([packed], pa.binary())], names=["chunk", "salt", "at", "n"])

    def fold(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, np.zeros(1 << _CHUNK, np.int64)
            done = lambda: bits(now[0], total) if last and least else _row(*now, total.astype(kind))
            for b in batches:
                for i in range(b.num_rows):
                    c, s, at, n = (b.column(x)[i].as_py() for x in ("chunk", "salt", "at", "n"))
                    if now is not None and (c, s) != now:
                        yield done()
                        total[:] = 0
                    now, at = (c, s), np.frombuffer(at, np.uint16)
                    total[at] = np.minimum(total[at] + np.frombuffer(n, kind).astype(np.int64), top)
            if now is not None:
                yield done()

        return run

    first = rows.repartition("chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(fold(False), SUMS)
    return first.withColumn("salt", F.lit(0)).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(fold(True), SUMS)


def _bitmap(rows: DataFrame, size: int, least: int) -> np.ndarray:
    """A bit for each bucket: whether it has ``least`` occurrences. The driver gets bits only, size / 8 bytes in all."""
    found = np.zeros(size // 8, np.uint8)
    for r in _summed(rows, least, least).select("chunk", "n").collect():
        begin = r.chunk << (_CHUNK - 3)
        found[begin : begin + (1 << (_CHUNK - 3))] = np.frombuffer(r.n, np.uint8)
    return found


def _bucket(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys >> np.uint64(65 - size.bit_length())).astype(np.int64)  # the highest bits; size is a power of two


def _passes(bitmap: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    at = _bucket(keys, size)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


# ---- the minimal perfect hash


@dataclass
class PerfectHash:
    """A slot below n for each of n keys: at each level, keys that are alone at a place stay there, the others go on."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]  # places, words of 64 bits, bits before each word
    stored: np.ndarray  # the key of each slot

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        rest, levels, before = keys, [], 0
        stored = np.empty(len(keys), np.uint64)
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = cls._place(rest, len(levels), size)
            once = np.bincount(at, minlength=size) == 1
            words = np.packbits(once, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            levels.append((size, words, (before + np.cumsum(counts) - counts).astype(np.uint32)))
            alone = once[at]
            stored[before + (np.cumsum(once) - 1)[at[alone]]] = rest[alone]
            before += int(alone.sum())
            rest = rest[~alone]
        return cls(levels, stored)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        scrambled = mix(keys + np.array([level], np.uint64) * _STEP)
        return ((scrambled >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, verified by the stored one; -1 for other keys."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, (size, words, rank) in enumerate(self.levels):
            at = self._place(keys[left], i, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & _ONE == _ONE
            slot = rank[at[here] >> 6].astype(np.int64) + np.bitwise_count(word[here] & ((_ONE << bit[here]) - _ONE))
            mine = self.stored[slot] == keys[left[here]]
            out[left[here][mine]] = slot[mine]
            left = left[~here]
            if not len(left):
                break
        return out


@dataclass
class Blocks:
    """Perfect hashes of some of the blocks into which keys are dealt, and the counts of their slots once they are known."""

    blocks: int  # of all; a power of two
    hashes: dict[int, PerfectHash]
    counts: dict[int, np.ndarray]

    def each(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(block, indices of the keys that it has, their slots)."""
        of = _block(keys, self.blocks)
        for b, h in self.hashes.items():
            at = np.flatnonzero(of == b)
            slots = h.slots(keys[at])
            yield b, at[slots >= 0], slots[slots >= 0]

    def count_of(self, keys: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The count of each key; as before for keys of other blocks."""
        out = before.copy()
        for b, at, slots in self.each(keys):
            out[at] = self.counts[b][slots]
        return out


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> _ONE) & np.uint64(blocks - 1)).astype(np.int64)


# ---- passes


def _grams(x: np.ndarray, bitmaps: list[np.ndarray], size: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, keys) of the phrases of 2 to ``last`` words whose two parts of k - 1 words passed."""
    keys, ok = x, x != 0
    for k in range(2, last + 1):
        at = np.flatnonzero(ok[:-1] & ok[1:])
        new = _longer(keys[at], x[at + k - 1])
        yield k, at, new
        if k < last:
            keys, ok = np.zeros_like(x), np.zeros(len(x), bool)
            keys[at], ok[at] = new, _passes(bitmaps[k - 2], new, size)


def _safe(x: np.ndarray, bitmaps: list[np.ndarray], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, keys) of the words and phrases that passed."""
    at = np.flatnonzero(x)
    yield 1, at, x[at]
    for k, at, keys in _grams(x, bitmaps, size, LONGEST):
        good = _passes(bitmaps[k - 2], keys, size)
        yield k, at[good], keys[good]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray]]:
    """Keys of many texts at once, which begin with a break each; their rows, and the numbers of keys of these."""
    for b in batches:
        for part in slices(iter([b]), "keys"):
            raw = part.column("keys")
            at = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
            if at[-1] > at[0]:
                yield np.frombuffer(raw.buffers()[2], np.uint64, (at[-1] - at[0]) // 8, at[0]), part, np.diff(at) // 8


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (x for x, *_ in _texts(batches))


def _keyed(batches: Iterator[pa.RecordBatch]):
    """For each slice: keys of its words, its words, the languages, and the language of each text."""
    for part in slices(batches, "text", 1 << 20):
        w = words_of(part.column("text"), space=_BETWEEN)
        langs = part.column("lang").dictionary_encode()
        names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        hashes = np.array([_language(x) for x in names], np.uint64)
        yield mix(w.hashes ^ np.repeat(hashes[of], np.diff(w.first))) | _ONE, w, names, of


def _word_buckets(docs: DataFrame, size: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Sparse(size, least)
        for keys, *_ in _keyed(batches):
            counts.add(_bucket(keys, size))
        yield from counts.rows()

    return docs.mapInArrow(run, SUMS)


def _fresh(new: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which of some sorted keys aren't among other sorted ones."""
    if not len(seen):
        return np.ones(len(new), bool)
    at = np.minimum(np.searchsorted(seen, new), len(seen) - 1)
    return seen[at] != new


_COMPACT = "lang string, keys binary, totals array<struct<lang: string, n: long>>, fresh array<struct<key: long, word: string>>"


def _compact(docs: DataFrame, sent: Broadcast, size: int) -> DataFrame:
    """For each text the keys of the words that passed, in order, 0 for a break.

    The first text of a slice also has the numbers of words by language, and the words that are new to the task.
    """
    total_type = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
    fresh_type = pa.list_(pa.struct([("key", pa.int64()), ("word", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(0, np.uint64)
        for keys, w, names, of in _keyed(batches):
            n_words = np.bincount(of, np.diff(w.first), len(names)).astype(np.int64)
            totals = [{"lang": a, "n": b} for a, b in zip(names, n_words.tolist(), strict=True)]
            fresh, data, sizes = [], b"", np.zeros(len(of), np.int64)
            if len(keys):
                good = _passes(sent.value, keys, size)
                breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])[w.starts]
                border = np.ones(len(keys), bool)
                border[1:] = (breaks[1:] != breaks[:-1]) | ~good[:-1]
                border[w.first[:-1][np.diff(w.first) > 0]] = True
                # a 0 stands before a word that begins a text or a piece, or follows one which didn't pass
                kept = np.flatnonzero(good)
                out = np.zeros(len(kept) + int(border[kept].sum()), np.uint64)
                out[np.arange(len(kept)) + np.cumsum(border[kept])] = keys[kept]
                text = np.searchsorted(w.first, kept, "right") - 1
                sizes = np.bincount(text, 1 + border[kept], len(of)).astype(np.int64)
                data = out.tobytes()
                new, at = np.unique(keys[kept], return_index=True)
                first = _fresh(new, seen)
                seen = np.union1d(seen, new[first])
                fresh = [{"key": k, "word": w.word(i).decode()} for k, i in zip(new[first].view(np.int64).tolist(), kept[at[first]].tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            rest = [[]] * (len(of) - 1)
            lang = pa.array(names, pa.string()).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([lang, raw, pa.array([totals, *rest], total_type), pa.array([fresh, *rest], fresh_type)], names=["lang", "keys", "totals", "fresh"])

    return docs.mapInArrow(run, _COMPACT)


def _phrase_buckets(compact: DataFrame, sent: Broadcast, size: int, k: int, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Sparse(size, least)
        for x in _arrays(batches):
            for n, _, keys in _grams(x, sent.value, size, k):
                if n == k:
                    counts.add(_bucket(keys, size))
        yield from counts.rows()

    return compact.select("keys").mapInArrow(run, SUMS)


_PARTS = 64
_FOUND = "lang string, k int, part int, words binary"
_CANDIDATES = "key long, lang string, words array<long>"


def _keys(words: np.ndarray) -> np.ndarray:
    """Keys of phrases given as rows of word keys."""
    out = words[:, 0]
    for k in range(1, words.shape[1]):
        out = _longer(out, words[:, k])
    return out


def _candidates(compact: DataFrame, sent: Broadcast, size: int) -> DataFrame:
    """(key, lang, words): each distinct word and phrase that passed, as keys.

    A task sends each of its own once, those of a language and length in ``_PARTS`` arrays by a hash; arrays are merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], np.ndarray] = {}  # sorted keys, of which the words follow
        words: dict[tuple[str, int], list[np.ndarray]] = {}
        for x, part, sizes in _texts(batches):
            end, langs = np.cumsum(sizes), part.column("lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for k, at, keys in _safe(x, sent.value, size):
                new, i = np.unique(keys, return_index=True)
                at = at[i]
                owner = of[np.searchsorted(end, at, "right")]
                for o in np.unique(owner).tolist():
                    mine, place = new[owner == o], at[owner == o]
                    before = seen.get((names[o], k), np.empty(0, np.uint64))
                    first = _fresh(mine, before)
                    seen[names[o], k] = np.union1d(before, mine[first])
                    words.setdefault((names[o], k), []).append(x[place[first][:, None] + np.arange(k)])
        for (lang, k), found in words.items():
            every = np.concatenate(found)
            every = every[np.lexsort(every.T[::-1])]  # common beginnings side by side compress well
            part = (_keys(every) >> np.uint64(8)) % np.uint64(_PARTS)
            for i in range(_PARTS):
                if (part == i).any():
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([every[part == i].tobytes()], pa.binary())], names=["lang", "k", "part", "words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def distinct() -> np.ndarray:
            every = np.concatenate(held)
            return every[np.unique(_keys(every), return_index=True)[1]]

        def done() -> Iterator[pa.RecordBatch]:
            every, k = distinct(), now[1]
            for i in range(0, len(every), 50_000):
                rows = every[i : i + 50_000]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(rows.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(_keys(rows).view(np.int64)), pa.array([now[0]] * len(rows), pa.string()), lists], names=["key", "lang", "words"])

        for b in batches:
            for i in range(b.num_rows):
                group = tuple(b.column(x)[i].as_py() for x in ("lang", "k", "part"))
                if now is not None and group != now:
                    yield from done()
                    held, n = [], 0
                now = group
                held.append(np.frombuffer(b.column("words")[i].as_py(), np.uint64).reshape(-1, group[1]))
                n += len(held[-1])
                if len(held) > 1 and n > 200_000:
                    held = [distinct()]
                    n = 0  # what is distinct stays; so much more may come
        if now is not None:
            yield from done()

    found = compact.select("lang", "keys").mapInArrow(run, _FOUND)
    return found.repartition("lang", "k", "part").sortWithinPartitions("lang", "k", "part").mapInArrow(merge, _CANDIDATES)


def _built(candidates: DataFrame, blocks: int) -> DataFrame:
    """(block, keys): the keys of each block in the order of their slots, of which the hash follows."""

    def build(table: pa.Table) -> pa.Table:
        keys = np.sort(table.column("key").to_numpy().view(np.uint64))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "keys": pa.array([PerfectHash.build(keys).stored.tobytes()], pa.binary())})

    block = F.shiftrightunsigned("key", 1).bitwiseAND(F.lit(blocks - 1).cast("long"))
    return candidates.select("key", block.alias("block")).groupBy("block").applyInArrow(build, "block long, keys binary")


def _slot_counts(compact: DataFrame, sent: Broadcast, ready: Broadcast, size: int) -> DataFrame:
    """Counts of all slots of the blocks at hand; chunk numbers begin with the block's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = ready.value
        total = {b: Sparse(0, _WIDE) for b in blocks.hashes}
        for b, t in total.items():
            t.n = np.zeros(len(blocks.hashes[b].stored), np.min_scalar_type(_WIDE))
        for x in _arrays(batches):
            for _, _, keys in _safe(x, sent.value, size):
                for b, _, slots in blocks.each(keys):
                    total[b].n += np.bincount(slots, minlength=len(total[b].n)).astype(total[b].n.dtype)
        for b, t in total.items():
            yield from t.rows(b << 20)

    return compact.select("keys").mapInArrow(run, SUMS)


_WIDE = 1 << 62


def _part_keys(words: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of the first k words and of the rest, for each cut of phrases given as rows of word keys."""
    length = words.shape[1]
    firsts, rests = [words[:, 0]], []
    for k in range(1, length - 1):
        firsts.append(_longer(firsts[-1], words[:, k]))
    for k in range(1, length):
        rest = words[:, k]
        for j in range(k + 1, length):
            rest = _longer(rest, words[:, j])
        rests.append(rest)
    return firsts, rests


_READ = "key long, lang string, words array<long>, a long, l array<long>, r array<long>, first long, rest long"


def _read(rows: DataFrame, ready: Broadcast, least: int, begin: bool) -> DataFrame:
    """Rows of ``_READ``: counts of phrases and of both sides of each cut, read by slot; -1 where another block has them.

    Words and phrases with too small a count go. ``first`` and ``rest`` are the keys without the last and the first word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("words").value_lengths().to_numpy(zero_copy_only=False)
            for length in [k for k in np.unique(lengths).tolist() if k > 1]:
                part = b.filter(pa.array(lengths == length))
                keys = part.column("key").to_numpy().view(np.uint64)
                words = part.column("words").flatten().to_numpy().view(np.uint64).reshape(-1, length)
                unknown = np.full(len(keys), -1, np.int64)
                a = ready.value.count_of(keys, unknown if begin else part.column("a").to_numpy())
                good = (a < 0) | (a >= least)
                part, keys, words, a = part.filter(pa.array(good)), keys[good], words[good], a[good]
                sides = _part_keys(words)
                before = [np.full((len(keys), length - 1), -1, np.int64) if begin else part.column(c).flatten().to_numpy().reshape(-1, length - 1) for c in ("l", "r")]
                counts = [np.stack([ready.value.count_of(s[k], old[:, k]) for k in range(length - 1)], 1) for s, old in zip(sides, before, strict=True)]
                at = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * (length - 1))
                lists = [pa.ListArray.from_arrays(at, pa.array(c.ravel())) for c in counts]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("lang"), part.column("words"), pa.array(a), *lists, pa.array(sides[0][-1].view(np.int64)), pa.array(sides[1][0].view(np.int64))], names=["key", "lang", "words", "a", "l", "r", "first", "rest"])

    return rows.mapInArrow(run, _READ)


@dataclass
class Phrases:
    """Frequent phrases (``_READ``, l and r by cut), words that a task met first, by key, and word occurrences by language."""

    frequent: DataFrame
    fresh: DataFrame
    totals: DataFrame

    def words(self, keys: DataFrame, most: int = 1 << 20) -> DataFrame:
        """(key, word) of some distinct keys (key); 8 bytes of each of ``most`` of them are broadcast at once."""
        out, n = [], -(-keys.count() // most)
        for i in range(max(1, n)):
            some = keys if n < 2 else keys.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i)
            sent = keys.sparkSession.sparkContext.broadcast(np.sort(some.toArrow().column("key").to_numpy()))
            out.append(self.fresh.mapInArrow(_named(sent), "key long, word string"))
        return reduce(DataFrame.unionAll, out).groupBy("key").agg(F.first("word").alias("word"))


def _named(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("fresh").flatten()
            keys, word = every.field("key"), every.field("word")
            asked = np.isin(keys.to_numpy(zero_copy_only=False), sent.value)
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(asked)), word.filter(pa.array(asked))], names=["key", "word"])

    return run


def count_phrases(docs: DataFrame, least: int = 100, bound: int = 64_000_000, block_keys: int = 1 << 20) -> Phrases:
    """Phrases of 2 to 5 words with at least ``least`` occurrences, of docs (text, lang)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = 1 << min(26, max(18, (n_bytes // 64).bit_length()))
    share = spark.sparkContext.broadcast
    sent = share(_bitmap(_word_buckets(docs, size, least), size, least))
    compact = store.written(_compact(docs, sent, size), "phrase-keys", **{"parquet.block.size": str(8 << 20)})  # else each writer holds 128 MB
    bitmaps: list[np.ndarray] = []
    for k in range(2, LONGEST + 1):
        sent.destroy()
        sent = share(bitmaps)
        bitmaps = [*bitmaps, _bitmap(_phrase_buckets(compact, sent, size, k, least), size, least)]
    sent.destroy()
    sent = share(bitmaps)
    candidates = store.written(_candidates(compact, sent, size), "phrase-candidates")
    blocks = 1 << (candidates.count() // block_keys).bit_length()
    built = store.written(_built(candidates, blocks), "phrase-blocks")
    # blocks that are in memory at once: keys, counts and the hash have some 18 bytes a key
    groups, total = [[]], 0
    for block, n in sorted(built.select("block", F.octet_length("keys") * 18 / 8).collect()):
        if groups[-1] and total + n > bound:
            groups.append([])
            total = 0
        groups[-1].append(block)
        total += n

    def ready(group: list[int], sums: DataFrame | None) -> Broadcast:
        hashes = {r.block: PerfectHash.build(np.frombuffer(r["keys"], np.uint64)) for r in built.where(F.col("block").isin(group)).toLocalIterator()}
        counts = {b: np.zeros(len(h.stored), np.int64) for b, h in hashes.items()}
        if sums is not None and group:
            for r in sums.where(F.shiftright("chunk", 20).isin(group)).toLocalIterator():
                counts[r.chunk >> 20][_indices(r.chunk & ((1 << 20) - 1), r["at"])] = np.frombuffer(r.n, np.uint64).astype(np.int64)
        return share(Blocks(blocks, hashes, counts))

    rows, sums = candidates, []
    for group in groups:
        now = ready(group, None)
        sums.append(store.written(_summed(_slot_counts(compact, sent, now, size), _WIDE), "phrase-sums"))
        now.destroy()
    sent.destroy()
    for i, group in enumerate(groups):
        now = ready(group, sums[i])
        rows = store.written(_read(rows, now, least, not i), "phrase-counts")
        now.destroy()
    totals = compact.select(F.explode("totals").alias("x")).groupBy("x.lang").agg(F.sum("x.n").alias("n"))
    return Phrases(rows, compact.select("fresh").where(F.size("fresh") > 0), totals)


_SCORED = "key long, lang string, words array<long>, a long, n long, l long, r long, score long"


def _scored(rows: DataFrame) -> DataFrame:
    """The lowest-scoring cut, by integers of any size; of equal scores the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = []
            for a, n, left, right in zip(*(b.column(x).to_pylist() for x in ("a", "n", "l", "r")), strict=True):
                scores = [1000 * a * n // (x * y) for x, y in zip(left, right, strict=True)]
                k = scores.index(min(scores))
                best.append((left[k], right[k], scores[k]))
            found = np.array(best, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("key", "lang", "words", "a", "n")), *(pa.array(found[:, i]) for i in range(3))], names=["key", "lang", "words", "a", "n", "l", "r", "score"])

    return rows.mapInArrow(run, _SCORED)


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, bound: int = 64_000_000, block_keys: int = 1 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of each language.

    The score is 1000 a n / (l r) of the cut where it is lowest.  A phrase inside a longer one with as many occurrences is left out.
    """
    found = count_phrases(docs, least, bound, block_keys)
    rows = found.frequent
    # a longer phrase as frequent as one inside it has a part of one word less as frequent, too
    inside = [rows.where((F.size("words") > 2) & (F.col("a") == n)).select(F.col(key).alias("key")) for key, n in (("first", F.element_at("l", -1)), ("rest", F.element_at("r", 1)))]
    kept = rows.join(reduce(DataFrame.unionAll, inside).distinct(), "key", "left_anti")
    scored = _scored(kept.select("key", "lang", "words", "a", "l", "r").join(found.totals, "lang"))
    order = [F.desc("score"), F.desc("a")]
    # the best of parts of a language, then of those: no task has all phrases of one; equals at the end all stay until they have names
    part = scored.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64)))
    some = part.withColumn("rank", F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    some = some.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    some = store.written(some.drop("rank", "part"), "phrase-best")
    word = found.words(some.select(F.explode("words").alias("key")).distinct()).withColumnRenamed("key", "word_key")
    spelled = some.select("key", F.posexplode("words").alias("i", "word_key")).join(word, "word_key").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = some.join(spelled, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
