"""Words and shingles of whole texts as 64-bit hashes, a column at a time.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased.  Everything here works on the bytes of
an Arrow column with numpy; no step loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        steps = np.full(n, _P if which == "up" else _P_INVERSE, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Words of some texts in order. ``first`` has, for each text and one past the last, the index of its first word."""

    data: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray | None = None  # of the texts in data, for those who need them

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """Split and hash the words of every text, A-Z lower-cased if asked for. A null counts as empty.

    ``space`` says for each of the 256 bytes whether it is between words.
    """
    raw, at = _bytes(texts)
    data = _LOWER[raw] if lower else raw
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return Words(data, empty, empty, np.zeros(len(at), np.int64), np.empty(0, np.uint64))
    word = ~space[data]
    border = np.zeros(n + 1, bool)
    border[at] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | border[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n)[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64) * _PLACE[1])
    return Words(data, starts, ends, np.searchsorted(starts, at), hashes)


def shingles_of(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text of each. A text with fewer words gives its whole sequence."""
    n, hashes = np.diff(words.first), words.hashes
    place = [_PLACE[i % 5] + np.uint64(2 * (i // 5)) for i in range(width)]
    owners, out = [], []
    if len(hashes) >= width:
        total = hashes[: len(hashes) - width + 1] * place[0]
        for i in range(1, width):
            total = total + hashes[i : len(hashes) - width + 1 + i] * place[i]
        owner = words.owner()
        inside = owner[: len(total)] == owner[width - 1 :]
        owners.append(owner[: len(total)][inside])
        out.append(mix(total[inside]))
    for k in range(1, width):
        which = np.flatnonzero(n == k)
        if len(which):
            at = words.first[:-1][which]
            owners.append(which)
            out.append(mix(sum(hashes[at + i] * place[i] for i in range(k)) + np.uint64(k)))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner, out = np.concatenate(owners), np.concatenate(out)
    if len(owners) > 1:
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return out, owner


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner and then value."""
    order = np.lexsort((values, owner)) if len(values) else np.empty(0, np.int64)
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of at most ``most`` bytes of text (or one row), which bounds a worker's memory; no row is left out."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
