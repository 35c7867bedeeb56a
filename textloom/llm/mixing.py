"""LM scoring by logistic context mixing.

A text, A-Z lower-cased, is coded as units: its words, each with a terminator (one space, one line feed, end of text, or an escape after
which the white space follows as a unit of its own).  A unit's bytes are predicted bit by bit.  ``ORDERS`` contexts (the
last 1 to 4 bytes within the unit, and all of it so far), hashed with the bits so far into tables of counts, each give a
probability; their logits are mixed by weights that are gated by how well the two longest contexts are known and by the
bit's position, and the result is refined by an adaptive map from mixed to observed probabilities.

What is gathered: counts of every context of all training texts (summed over the corpus, which grows with it), then gated
weights by online gradient steps over the training units (each unit is predicted with one occurrence of itself taken out
of the counts, as if it came next), averaged over groups of units; then the adaptive map.  A unit's cost depends on the unit alone,
so each distinct unit of the corpus is coded once and texts sum up what their units cost.

Before a word is coded by its letters, one bit tells whether it follows the word before it as it did when that stood in this
text last.  Its chance goes by how many words had been the same there, starts at the rate of all training texts and adapts
to the text as it is coded.  So contexts reach over words, and order counts.

Texts are dealt into blocks of about ``block_docs`` documents by a hash.  Blocks send their distinct words and get back
those words' counts and costs, so no task holds the corpus' vocabulary.

Defined results: a null text is empty; a null doc_id is in training; repeated rows are scored and counted each; a table
without training texts has train_tokens 0 and all costs from an untrained model; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.store import written
from textloom.llm.words import _bytes, mix, slices, words_of

ORDERS = 5
_SLOTS = 20  # bits of a table
_TERMS = np.array([0x20, 0x0A, 0xFF, 0xFE], np.uint8)  # one space, one line feed, end of text, escape: no bytes of a word in UTF-8
_GATES = 128
_BUCKETS = 33
_CHUNK = 400_000  # bytes coded at a time
_PRIOR = 4.0  # occurrences that the corpus' rate of echoes counts for
_GROUP = 100_000  # units of a group on which weights are trained
SCORED = "unit string, c long, packed long, terms long"


class Events:
    """The bytes to predict of some units: all bytes of each, then its four terminators as alternatives.

    Units that begin alike share events; ``at`` gives the event of each byte.  For training, events that don't occur are left out.
    """

    def __init__(self, units: pa.Array, counts: np.ndarray, training: bool = False):
        raw, at = _bytes(units)
        n, size = len(units), np.diff(at)
        pad = 5
        begin = at[:-1] + pad * np.arange(1, n + 1)
        flat = np.full(len(raw) + pad * n + 1, 0x20, np.uint32)
        owner = np.repeat(np.arange(n), size)
        where = np.arange(len(raw)) + pad * (owner + 1)
        flat[where] = raw
        place = np.concatenate([where, np.repeat(begin + size, 4)])
        self.unit = np.concatenate([owner, np.repeat(np.arange(n), 4)])
        self.term = np.concatenate([np.full(len(raw), -1), np.tile(np.arange(4), n)])
        byte = np.concatenate([raw, np.tile(_TERMS, n)]).astype(np.uint32)
        weight = np.concatenate([counts.sum(axis=1)[owner], counts.ravel()]).astype(np.float64)
        sums = np.zeros(len(flat) + 1, np.uint64)
        value = flat.astype(np.uint64) + np.uint64(1)
        step = np.uint64(0x9E3779B97F4A7C15)
        np.cumsum(value * np.cumprod(np.full(len(flat), step), dtype=np.uint64), out=sums[1:])
        back = np.cumprod(np.full(len(flat) + 1, np.uint64(pow(int(step), -1, 2**64))), dtype=np.uint64)
        start = begin[self.unit]
        prefix = mix((sums[place] - sums[start]) * back[start])
        if training:
            some = np.flatnonzero(weight)
            prefix, byte, weight, place = prefix[some], byte[some], weight[some], place[some]
        _, first, self.at = np.unique(mix(prefix ^ byte.astype(np.uint64)), return_index=True, return_inverse=True)
        self.byte, self.weight = byte[first], np.bincount(self.at, weight)
        place, prefix = place[first], prefix[first]
        p = [flat[place - i] for i in range(1, 5)]
        whole = (prefix >> np.uint64(32)).astype(np.uint32)
        low = p[0] | p[1] << np.uint32(8)
        self.contexts = [
            p[0] * np.uint32(0x2545F491),
            low * np.uint32(0x9E3779B1) + np.uint32(1),
            (low | p[2] << np.uint32(16)) * np.uint32(0x85EBCA77) + np.uint32(2),
            (low | p[2] << np.uint32(16) | p[3] << np.uint32(24)) * np.uint32(0xC2B2AE3D) + np.uint32(3),
            whole,
        ]

    def bit(self, j: int) -> np.ndarray:
        return (self.byte >> np.uint32(7 - j)) & np.uint32(1)

    def slots(self, j: int) -> list[np.ndarray]:
        so_far = ((self.byte | np.uint32(256)) >> np.uint32(8 - j)) * np.uint32(0x9E3779B1)
        out = []
        for c in self.contexts:
            h = (c ^ so_far) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            out.append(((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - _SLOTS)).astype(np.int64))
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in slices(batches, "unit", _CHUNK):
        for i in range(0, part.num_rows, _CHUNK // 4):
            piece = part.slice(i, _CHUNK // 4)
            yield piece, np.stack([piece.column(f"t{k}").to_numpy() for k in range(4)], axis=1)


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's counts of every context and bit, in pieces of the tables."""
    tables = np.zeros((ORDERS, 2 << _SLOTS), np.float64)
    some = False
    for piece, counts in _chunks(batches):
        seen = counts.sum(axis=1) > 0
        if not seen.any():
            continue
        some = True
        e = Events(piece.column("unit").filter(pa.array(seen)), counts[seen], True)
        for j in range(8):
            bit = e.bit(j).astype(np.int64)
            for k, slot in enumerate(e.slots(j)):
                tables[k] += np.bincount(slot * 2 + bit, e.weight, 2 << _SLOTS)
    if some:
        flat = tables.astype(np.int64).reshape(-1, 1 << 16)
        for i, piece in enumerate(flat):
            if piece.any():
                data = pa.compress(piece.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data], pa.binary())], names=["piece", "data"])


def _add(parts: pa.Table) -> pa.Table:
    total = np.zeros(1 << 16, np.int64)
    for data in parts.column("data"):
        total += np.frombuffer(pa.decompress(data.as_buffer(), 8 << 16, codec="zstd"), np.int64)
    data = total.astype(np.float32).tobytes()  # odds need no more than 24 bits, and no count is too large
    return pa.table({"piece": parts.column("piece").slice(0, 1), "data": pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary())})


def packed(tables: np.ndarray) -> bytes:
    return pa.compress(tables.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, ORDERS * 8 << _SLOTS, codec="zstd"), np.float32).reshape(ORDERS, 2 << _SLOTS)


class Model:
    """Count tables (of a fixed size), gated weights and the adaptive map."""

    def __init__(self, tables: np.ndarray):
        self.counts = tables.reshape(ORDERS, 1 << _SLOTS, 2)
        self.weights = np.full((_GATES, ORDERS + 1), 0.35, np.float32)
        self.weights[:, ORDERS] = 0
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, _BUCKETS))), (_GATES, 1)).astype(np.float32)

    def inputs(self, e: Events, j: int, without: bool) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all predictors and the gate; ``without`` takes one occurrence out of the counts."""
        bit = e.bit(j)
        x = np.empty((ORDERS + 1, len(bit)), np.float32)
        levels = []
        for k, slot in enumerate(e.slots(j)):
            n = self.counts[k][slot]
            n0, n1 = n[:, 0], n[:, 1]
            if without:
                n0, n1 = np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0)
            x[k] = np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3)))
            if k >= ORDERS - 2:
                total = n0 + n1
                levels.append((total > 0).astype(np.int64) + (total > 2) + (total > 15))
        x[ORDERS] = 0.3
        return x, (levels[0] * 4 + levels[1]) * 8 + j

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape[1], np.float32)
        for k in range(ORDERS + 1):
            z += self.weights[:, k][gate] * x[k]
        return np.clip(z, -7.99, 7.99)

    def refined(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """P(bit = 1): the mean of the mixed probability and what the adaptive map says about it."""
        at = (z + 8) * np.float32((_BUCKETS - 1) / 16)
        low = at.astype(np.int64)
        part = at - low
        mapped = self.map[gate, low] * (1 - part) + self.map[gate, low + 1] * part
        return np.clip((1 / (1 + np.exp(-z)) + mapped) / 2, 1e-5, 1 - 1e-5)


def train_weights(sent):
    """Online gradient steps over the training units of one group, for each gate; gives the sums for an average over groups.

    Groups go by a hash and are sorted, so weights don't depend on how tasks were dealt.
    """

    def run(units: pa.Table) -> pa.Table:
        model = Model(unpacked(sent.value))
        seen = np.zeros(_GATES)
        for piece, counts in _chunks(iter(units.sort_by("unit").combine_chunks().to_batches())):
            some = np.flatnonzero(counts.sum(axis=1) > 0)
            steps = max(1, len(some) // 1024)  # a step every thousand units, from all over the alphabet
            for part in (some[i::steps] for i in range(steps)):
                if not len(part):
                    continue
                e = Events(piece.column("unit").take(pa.array(part)), counts[part], True)
                for j in range(8):
                    x, gate = model.inputs(e, j, True)
                    error = e.bit(j) - 1 / (1 + np.exp(-model.mixed(x, gate)))
                    total = np.bincount(gate, e.weight, _GATES)
                    rate = 0.5 / (1 + 0.02 * np.sqrt(seen / 1e4))
                    for k in range(ORDERS + 1):
                        step = np.bincount(gate, e.weight * error * x[k], _GATES) / np.maximum(total, 1)
                        model.weights[:, k] += (np.clip(step, -1, 1) * rate * np.minimum(1, total / 50)).astype(np.float32)
                    seen += total
        g = np.flatnonzero(seen)
        return pa.table({"gate": pa.array(g, pa.int64()), "seen": pa.array(seen[g]), "w": pa.array(model.weights[g].astype(float).tolist(), pa.list_(pa.float64()))})

    return run


def train_map(sent, weights):
    """How often bits are 1, by gate and bucket of the mixed logit, over this task's training units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(unpacked(sent.value))
        model.weights = weights
        ones, every = np.zeros(_GATES * _BUCKETS), np.zeros(_GATES * _BUCKETS)
        for piece, counts in _chunks(batches):
            seen = counts.sum(axis=1) > 0
            if not seen.any():
                continue
            e = Events(piece.column("unit").filter(pa.array(seen)), counts[seen], True)
            for j in range(8):
                x, gate = model.inputs(e, j, True)
                cell = gate * _BUCKETS + np.rint((model.mixed(x, gate) + 8) * ((_BUCKETS - 1) / 16)).astype(np.int64)
                every += np.bincount(cell, e.weight, len(every))
                ones += np.bincount(cell, e.weight * e.bit(j), len(ones))
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ones[at]), pa.array(every[at])], names=["cell", "ones", "every"])

    return run


def score_units(sent, weights, adaptive):
    """Log2 costs of every unit and of its terminators, packed: c and the cost in one long, four costs / 256 in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(unpacked(sent.value))
        model.weights, model.map = weights, adaptive
        for piece, counts in _chunks(batches):
            e = Events(piece.column("unit"), counts)
            cost = np.zeros(len(e.byte))
            for j in range(8):
                x, gate = model.inputs(e, j, False)
                p = model.refined(model.mixed(x, gate), gate)
                cost -= np.log2(np.where(e.bit(j) == 1, p, 1 - p))
            cost = cost[e.at]
            inside = e.term < 0
            own = np.bincount(e.unit[inside], cost[inside], piece.num_rows)
            ends = np.minimum(np.rint(cost[~inside].reshape(-1, 4) * 256), 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [piece.column("unit"), pa.array(counts.sum(axis=1)), pa.array(own.astype(np.float64).view(np.int64)), pa.array(np.ascontiguousarray(ends).view(np.int64).ravel())], names=["unit", "c", "packed", "terms"]
            )

    return run


def _units(words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terminator of every word; (start, end, text) of white-space units (a text that ends without a word has an empty one)."""
    first, at = words.first, words.bounds
    n = len(words.starts)
    owner = words.owner()
    last = np.zeros(n, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    stop = np.where(last, at[1:][owner], np.concatenate([words.starts[1:], [0]])[:n]) if n else np.empty(0, np.int64)
    gap = stop - words.ends
    byte = words.data[np.minimum(words.ends, len(words.data) - 1)] if n else np.empty(0, np.uint8)
    term = np.full(n, 3)
    term[(gap == 1) & ~last & (byte == 0x20)] = 0
    term[(gap == 1) & ~last & (byte == 0x0A)] = 1
    term[last & (gap == 0)] = 2
    after = np.flatnonzero(term == 3)
    some = np.diff(first) > 0
    lead_stop = np.where(some, words.starts[np.minimum(first[:-1], max(n - 1, 0))] if n else 0, at[1:])
    lead = np.flatnonzero(lead_stop > at[:-1])
    no_end = np.ones(words.texts, bool)
    no_end[owner[term == 2]] = False
    no_end = np.flatnonzero(no_end)
    starts = np.concatenate([words.ends[after], at[:-1][lead], at[1:][no_end]])
    ends = np.concatenate([stop[after], lead_stop[lead], at[1:][no_end]])
    texts = np.concatenate([owner[after], lead, no_end])
    return term, starts, ends, texts


def _hash_spaces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """White-space units are few; those of one kind share an entry."""
    known: dict[bytes, np.uint64] = {}
    out = np.empty(len(starts), np.uint64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        key = data[a:b].tobytes()
        if key not in known:
            h = np.array([0xA5A5 + len(key)], np.uint64)
            for x in key:
                h = mix(h * np.uint64(31) + np.uint64(x))
            known[key] = h[0]
        out[i] = known[key]
    return out


def _split(texts: pa.Array):
    words = words_of(texts)
    words.bounds = _bytes(texts)[1]
    term, starts, ends, owner = _units(words)
    spaces = _hash_spaces(words.data, starts, ends)
    # of a white-space unit only the empty one at the end of a text has terminator 2
    kind = np.where(starts == ends, 2, 3)
    return words, term, starts, ends, owner, spaces, kind


def block_units(docs: pa.Table) -> pa.Table:
    """Distinct units of one block with, for each terminator, how often they occur in its training texts."""
    hashes, counts, texts = [], [], []
    for part in slices(docs.to_batches(), "text"):
        words, term, starts, ends, owner, spaces, kind = _split(part.column("text"))
        train = ~part.column("held_out").to_numpy(zero_copy_only=False)
        h = np.concatenate([words.hashes, spaces])
        weight = np.concatenate([train[words.owner()], train[owner]]).astype(np.int64)
        at = np.concatenate([term, kind])
        a, b = np.concatenate([words.starts, starts]), np.concatenate([words.ends, ends])
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        hashes.append(distinct)
        counts.append(np.bincount(inverse * 4 + at, weight, len(distinct) * 4).astype(np.int64).reshape(-1, 4))
        size = (b - a)[first]
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = words.data[np.arange(offsets[-1]) + np.repeat(a[first] - offsets[:-1], size)] if offsets[-1] else words.data[:0]
        texts.append(pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]))
    h, c = np.concatenate(hashes), np.concatenate(counts)
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    total = np.stack([np.bincount(inverse, c[:, k], len(distinct)) for k in range(4)], axis=1).astype(np.int64)
    units = pa.concat_arrays(texts).take(pa.array(first)).cast(pa.string())
    block = docs.column("block").slice(0, 1)[0].as_py()
    return pa.table({"block": pa.array(np.full(len(distinct), block)), "hash": pa.array(distinct.view(np.int64)), "unit": units, **{f"t{k}": pa.array(total[:, k]) for k in range(4)}})


def echoes(words) -> tuple[np.ndarray, np.ndarray]:
    """For each word, how long a run of words before it stood in its text already (0 to 3), and whether the word is the one that followed there.

    The run is the one that ended last; what followed it is known before the word is coded.
    """
    h, n = words.hashes, len(words.hashes)
    owner, at = words.owner(), np.arange(n)
    order = np.lexsort((at, h, owner))
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    earlier = np.full(n, -1)
    earlier[order[1:][same]] = order[:-1][same]
    back = lambda k: (at >= k) & (owner[np.maximum(at - k, 0)] == owner)
    q = np.where(back(1), earlier[np.maximum(at - 1, 0)], -1)
    run, going = np.zeros(n, np.int64), q >= 0
    hit = going & (h[np.minimum(q + 1, max(n - 1, 0))] == h)
    for k in range(1, 4):
        run += going
        a, b = np.maximum(at - k - 1, 0), np.maximum(q - k, 0)
        going = going & back(k + 1) & (q >= k) & (owner[b] == owner) & (h[a] == h[b])
    return run, hit


def echo_bits(run: np.ndarray, hit: np.ndarray, owner: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Bits that tell, for each word with a run before it, whether it follows; the chance adapts within the text, from the corpus' rate on."""
    order = np.lexsort((np.arange(len(run)), run, owner))
    group = owner[order] * 4 + run[order]
    new = np.ones(len(order), bool)
    new[1:] = group[1:] != group[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    before = np.concatenate([[0], np.cumsum(hit[order])])
    seen, hits = np.arange(len(order)) - begin, before[:-1] - before[begin] if len(order) else np.zeros(0)
    p = np.clip((hits + _PRIOR * rates[run[order]]) / (seen + _PRIOR), 1e-4, 1 - 1e-4)
    bits = np.empty(len(run))
    bits[order] = -np.log2(np.where(hit[order], p, 1 - p))
    return np.where(run > 0, bits, 0.0)


def count_echoes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, hits, seen) of this task's training texts."""
    total = np.zeros((4, 2), np.int64)
    for part in slices(batches, "text"):
        run, hit = echoes(words_of(part.column("text")))
        total += np.stack([np.bincount(run, hit, 4).astype(np.int64), np.bincount(run, minlength=4)], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["run", "hits", "seen"])


def score_block(totals, rates: np.ndarray):
    tokens, kinds, end = totals

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        hashes = known.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        c, packed, terms = (known.column(x).to_numpy()[order] for x in ("c", "packed", "terms"))
        cost, ends = packed.view(np.float64), np.ascontiguousarray(terms).view(np.uint16).reshape(-1, 4) / 256.0
        logs, scale = np.log10(c + 1.0), float(np.log10(tokens + kinds + 1.0))
        out = []
        for part in slices(docs.to_batches(), "text"):
            words, term, _, _, owner, spaces, kind = _split(part.column("text"))
            at, of = np.searchsorted(hashes, words.hashes), words.owner()
            n = part.num_rows
            space = np.searchsorted(hashes, spaces)
            run, hit = echoes(words)
            own = np.where(hit, 0, cost[at]) + echo_bits(run, hit, of, rates)  # a word that follows as before needs no letters
            bits = np.bincount(of, own + ends[at, term], n) + np.bincount(owner, cost[space] + ends[space, kind], n)
            n_tokens = np.diff(words.first) + 1
            base = np.bincount(of, logs[at], n) + np.log10(end + 1.0) - n_tokens * scale
            n_known = np.bincount(of, c[at] > 0, n).astype(np.int64) + (end > 0)
            size = np.maximum(np.diff(words.bounds), 1)
            out.append(
                pa.table(
                    {
                        "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(n_known),
                        "train_tokens": pa.array(np.full(n, tokens)), "base_score": pa.array(base), "score": pa.array(-bits * np.log10(2)), "total_bits": pa.array(bits), "bits_per_byte": pa.array(bits / size),
                    }
                )
            )
        return pa.concat_tables(out) if out else pa.table({x: pa.array([], t) for x, t in _OUT})

    return run


_OUT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("total_bits", pa.float64()), ("bits_per_byte", pa.float64())]
_OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, total_bits double, bits_per_byte double"


def scores(docs: DataFrame, block_docs: int = 12_000) -> DataFrame:
    """Score every row of docs (doc_id, text); learns from rows whose crc32(doc_id as text) mod 7 is not 2."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    rows = docs.count()
    blocks = max(1, -(-rows // block_docs))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    pairs = written(docs.groupBy("block").applyInArrow(block_units, "block long, hash long, unit string, t0 long, t1 long, t2 long, t3 long"), "unit-blocks")
    units = written(pairs.groupBy("unit").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in range(4))).repartitionByRange("unit").sortWithinPartitions("unit"), "units")

    c = F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")
    word = ~F.col("unit").rlike(r"^[\x20\x09-\x0D]") & (F.col("unit") != "")
    n, v = units.where(word).agg(F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0)).first()
    end = docs.where(~F.col("held_out")).count()
    totals = (n + end, v + (end > 0), end)

    tables = np.zeros((ORDERS, 2 << _SLOTS), np.float32).reshape(-1, 1 << 16)
    pieces = units.mapInArrow(count_contexts, "piece long, data binary").groupBy("piece").applyInArrow(_add, "piece long, data binary")
    for r in pieces.toLocalIterator():  # as many pieces as the tables have, whatever the corpus
        tables[r["piece"]] = np.frombuffer(pa.decompress(bytes(r["data"]), 4 << 16, codec="zstd"), np.float32)
    tables = tables.reshape(ORDERS, 2 << _SLOTS)
    sent = sc.broadcast(packed(tables))  # sent once, compressed; weights and map are a few KB and go with the code
    weights = Model(tables).weights
    groups = F.pmod(F.xxhash64("unit"), F.lit(max(1, -(-units.count() // _GROUP))))
    own = units.withColumn("group", groups).groupBy("group").applyInArrow(train_weights(sent), "gate long, seen double, w array<double>")
    sums = own.groupBy("gate").agg(*(F.sum(F.col("seen") * F.col("w")[k]).alias(f"w{k}") for k in range(ORDERS + 1)), F.sum("seen").alias("seen"))
    for r in sums.collect():  # a row a gate
        weights[r["gate"]] = [r[f"w{k}"] / r["seen"] for k in range(ORDERS + 1)]
    adaptive = Model(tables).map
    flat = adaptive.reshape(-1)
    for r in units.mapInArrow(train_map(sent, weights), "cell long, ones double, every double").groupBy("cell").agg(F.sum("ones"), F.sum("every")).collect():  # a row a cell
        flat[r[0]] = (r[1] + 4 * flat[r[0]]) / (r[2] + 4)
    rates = np.full(4, 0.5)
    for r in docs.where(~F.col("held_out")).mapInArrow(count_echoes, "run long, hits long, seen long").groupBy("run").agg(F.sum("hits"), F.sum("seen")).collect():  # four rows
        rates[r[0]] = (r[1] + 1) / (r[2] + 2)
    scored = units.mapInArrow(score_units(sent, weights, adaptive), SCORED)
    back = pairs.select("block", "hash", "unit").join(scored, "unit").select("block", "hash", "c", "packed", "terms")
    return docs.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score_block(totals, rates), _OUT_SQL)
