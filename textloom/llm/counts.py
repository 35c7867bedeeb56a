"""Token counts at every prefix of a text, for byte-level BPE tokenizers, by prefix dynamic programming.

The encoding of a prefix is unique and ends with one token.  That is the one token which is compatible with the last token
of the prefix before it, two tokens being compatible if merging their bytes by rank gives back the two.  So the count of a
prefix is the count of the prefix before its last token, and one more.  Distinct words are sorted and share the states of
what they have in common with the word before.  Counts of a text are those of its words, added up:

* a run of white space is one word as long as nothing follows it, and falls in two once a word does;
* a contraction's letters are a word of their own until it is complete;
* a special token's text is ordinary until it is complete, then one token.

Counts are stored for every prefix of code points, so where to cut a text, or whether it fits, needs no encoding:
``fitting`` and ``count_at`` are plain expressions over the stored array.  Counts do not only grow along a text: a longer
prefix can have fewer tokens.  ``fitting`` gives the longest prefix that keeps to the limit.

Defined results: a null or empty text has no token and an empty array; repeated rows are counted each; other columns are
kept, ``prefix_tokens``, ``n_bytes`` and ``n_tokens`` are replaced; an empty table gives no row; special tokens inside
texts count as the tokenizers library's default has them.  A worker keeps the words it has counted, about ``keep`` bytes
of them at most, then starts anew; a text is whole in a worker's memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.words import slices

#: The published pattern by which byte-level BPE cuts texts into words (fixed).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable Latin ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Merges:
    """Tokens as numbers by rank: bytes first, then each merge's result."""

    tokens: list[bytes]
    left: list[int]
    right: list[int]
    special: list[str]
    odd: str  # ranges of code points which the pattern's classes of this machine don't have as the library has them

    @classmethod
    def load(cls, path: str) -> Merges:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("ignore_merges") or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE that takes texts as they are")
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or any(a != b and a in b for a in special for b in special):
            raise ValueError("special tokens that take more than their own text")
        letters = _byte_letters()
        tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(tokens)}
        left, right = list(range(256)), list(range(256))
        for m in model["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            if a + b in number:
                raise ValueError("a token that two merges make")
            number[a + b] = len(tokens)
            tokens.append(a + b), left.append(number[a]), right.append(number[b])
        # classes differ by the version of Unicode: what is unassigned for one and a letter for the other is asked
        library, newer = Tokenizer.from_file(path).pre_tokenizer, regex.compile(r"[\p{L}\p{N}\s]")
        asked = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and newer.match(chr(c)) and unicodedata.category(chr(c)) == "Cn"]
        odd = [c for c in asked if len(library.pre_tokenize_str(f"!{c}")) == 1]
        ranges: list[list[int]] = []
        for c in map(ord, odd):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return cls(tokens, left, right, special, "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges))


class Counter:
    def __init__(self, m: Merges):
        self.number = {t: i for i, t in enumerate(m.tokens)}
        self.left, self.right, self.special = m.left, m.right, m.special
        self.pairs = {(m.left[i], m.right[i]): i for i in range(256, len(m.tokens))}
        self.begins = {t[:k] for t in m.tokens for k in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(PATTERN).findall
        self.odd = re.compile(f"[{m.odd}]") if m.odd else None
        self.marks = regex.compile("|".join(map(regex.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two tokens' bytes gives the two: nothing may merge across their border before they are complete.

        The tokens are taken apart again, the one of higher rank first, and each pair that ever met at the border is
        looked up: it would have merged if its rank is below that of what came to be beside it.
        """
        ok = self.fits.get((a, b))
        if ok is None:
            x, y, below, ok = a, b, len(self.left), True
            while True:
                met = self.pairs.get((x, y))
                if met is not None and met < below:
                    ok = False
                    break
                if x < 256 and y < 256:
                    break
                # of equals the left one is made first
                if x > y or y < 256:
                    below, x = x, self.right[x]
                else:
                    below, y = y + 1, self.left[y]
            self.fits[a, b] = ok
        return ok

    def first(self, t: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = t < 256 or (self.first(self.left[t]) and self.first(self.right[t]) and self._made(t))
        return ok

    def _made(self, t: int) -> bool:
        a, b = self.left[t], self.right[t]
        x, y, below = a, b, t
        while x >= 256 or y >= 256:
            if x > y or y < 256:
                below, x = min(below, x), self.right[x]
            else:
                below, y = min(below, y + 1), self.left[y]
            met = self.pairs.get((x, y))
            if met is not None and met < below:
                return False
        return True

    def counts_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its counts at every code point as 4-byte integers) of words sorted by their UTF-8."""
        number, begins, compatible, fits = self.number, self.begins, self.compatible, self.fits
        last, count, reach, earlier = [-1], [0], [0], b""
        for word in words:
            b = word.encode()
            n, most = 0, min(len(b), len(earlier))
            while n < most and b[n] == earlier[n]:
                n += 1
            del last[n + 1 :], count[n + 1 :], reach[n + 1 :]
            r = reach[n]
            for end in range(n + 1, len(b) + 1):
                r += 1
                while b[end - r : end] not in begins:
                    r -= 1
                for begin in range(end - r, end):
                    t = number.get(b[begin:end])
                    if t is not None:
                        if begin:
                            ok = fits.get((last[begin], t))
                            if ok is None:
                                ok = compatible(last[begin], t)
                        else:
                            ok = self.first(t)
                        if ok:
                            break
                last.append(t), count.append(count[begin] + 1), reach.append(r)
            earlier = b
            if len(b) == len(word):
                yield word, array("I", count[1:]).tobytes()
            else:  # only at code points
                yield word, array("I", [count[i] for i in range(1, len(b) + 1) if i == len(b) or b[i] & 0xC0 != 0x80]).tobytes()

    def words(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            # such a character is no letter to the library: a snowman stands for it
            ends = np.cumsum([len(w) for w in self.split(self.odd.sub("☃", text))]).tolist()
            return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return self.split(text)


_RUNS = regex.compile(r"\s\s+(?=\S)")
_SHORTENED = regex.compile(r"'(?:ll|ve|re)")


class Texts:
    """Counts of texts, with the words that were counted kept up to a bound of bytes."""

    def __init__(self, m: Merges, keep: int):
        self.counter, self.keep = Counter(m), keep
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, flat: list[str]) -> None:
        new = set(flat).difference(self.known)
        cost = sum(map(len, new)) * 5 + 150 * len(new)
        if self.size + cost > self.keep:
            self.known.clear(), self.counter.fits.clear()
            new, self.size = set(flat), 0
            cost = sum(map(len, new)) * 5 + 150 * len(new)
        before = len(self.counter.fits)
        self.known.update(self.counter.counts_sorted(sorted(new)))
        self.size += cost + 150 * (len(self.counter.fits) - before)

    def _plain(self, texts: list[str], prefixes: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Totals of texts without special tokens, and the counts at every prefix if asked for."""
        words = [self.counter.words(x) for x in texts]
        runs = [[(m.start(), m.end()) for m in _RUNS.finditer(x)] for x in texts] if prefixes else []
        flat = [w for ws in words for w in ws]
        self._learn([*flat, *(x[a:b] for x, ab in zip(texts, runs, strict=False) for a, b in ab)])
        inner = np.frombuffer(b"".join(map(self.known.__getitem__, flat)), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        total = np.concatenate([[0], np.cumsum(inner[np.cumsum(sizes) - 1])]) if len(flat) else np.zeros(1, np.int64)
        at = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        totals = total[at[1:]] - total[at[:-1]]
        if not prefixes:
            return totals, []
        whole = inner + np.repeat(total[:-1], sizes)
        chars = np.concatenate([[0], np.cumsum(sizes)])[at]
        out = []
        for i, (x, ab) in enumerate(zip(texts, runs, strict=True)):
            c = whole[chars[i] : chars[i + 1]] - total[at[i]]
            for a, b in ab:
                c[a:b] = (c[a - 1] if a else 0) + np.frombuffer(self.known[x[a:b]], np.uint32)
            if "'" in x:  # "'l" is two words until the second l comes
                for m in _SHORTENED.finditer(x):
                    begin = m.start()
                    if self._begins_word(words[i], begin):
                        c[begin + 1] = c[begin] + 1
            out.append(c)
        return totals, out

    @staticmethod
    def _begins_word(words: list[str], begin: int) -> bool:
        at = 0
        for w in words:
            if at >= begin:
                return at == begin
            at += len(w)
        return False

    def count(self, texts: list[str], prefixes: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """(tokens of each text, counts at every prefix of each or nothing)."""
        marks = self.counter.marks
        special = [i for i, x in enumerate(texts) if marks is not None and marks.search(x)] if marks is not None else []
        if not special:
            return self._plain(texts, prefixes)
        apart = set(special)
        plain = [i for i in range(len(texts)) if i not in apart]
        totals, arrays = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)] * len(texts)
        got, out = self._plain([texts[i] for i in plain], prefixes)
        totals[plain] = got
        for i, c in zip(plain, out, strict=False):
            arrays[i] = c
        for i in special:
            found = list(marks.finditer(texts[i]))
            begins = [0, *(m.end() for m in found)]
            # a part is counted with the special text after it, less its last letter: ordinary until complete
            parts = [texts[i][a : m.end() - 1] for a, m in zip(begins, found, strict=False)] + [texts[i][begins[-1] :]]
            _, out = self._plain(parts, True)
            base, pieces = 0, []
            for c, a, m in zip(out, begins, found, strict=False):
                n = m.start() - a
                pieces += [base + c, [base + (int(c[n - 1]) if n else 0) + 1]]
                base = int(pieces[-1][0])
            pieces.append(base + out[-1])
            arrays[i] = np.concatenate(pieces).astype(np.int64)
            totals[i] = arrays[i][-1]
        return totals, arrays if prefixes else []


def prefix_counts(docs: DataFrame, model: str | None = None, prefixes: bool = True, keep: int = 100_000_000) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and, if asked for, prefix_tokens: the count at every prefix of 1, 2, ... code points."""
    sent = docs.sparkSession.sparkContext.broadcast(Merges.load(model or default_model()))  # a fixed size, the model's
    docs = docs.drop("prefix_tokens", "n_bytes", "n_tokens")
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())] + ([T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))] if prefixes else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Texts(sent.value, keep)
        for part in slices(batches, "text"):
            text = part.column("text")
            totals, arrays = known.count([x or "" for x in text.to_pylist()], prefixes)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            out = [size, pa.array(totals, pa.int64())]
            if prefixes:
                at = np.concatenate([[0], np.cumsum([len(c) for c in arrays])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else [], pa.int32())))
            yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *(f.name for f in new)])

    return docs.mapInArrow(run, T.StructType([*docs.schema, *new]))


def count_at(prefix_tokens: Column, chars: Column) -> Column:
    """Tokens of the first ``chars`` code points; all of them if there are fewer."""
    return F.when(chars <= 0, F.lit(0)).otherwise(F.coalesce(F.get(prefix_tokens, F.least(chars, F.size(prefix_tokens)).cast("int") - 1), F.lit(0)))


def fitting(prefix_tokens: Column, limit: Column) -> Column:
    """Code points of the longest prefix that has ``limit`` tokens at most."""
    over = F.transform(prefix_tokens, lambda n, i: F.when(n <= limit, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(over), F.lit(0))


def truncated(counted: DataFrame, limit: int) -> DataFrame:
    """Rows of ``prefix_counts`` with text cut to the longest prefix of ``limit`` tokens at most, and its counts."""
    chars = fitting(F.col("prefix_tokens"), F.lit(limit))
    cut = counted.withColumn("prefix_tokens", F.slice("prefix_tokens", F.lit(1), chars)).withColumn("text", F.left(F.coalesce("text", F.lit("")), F.size("prefix_tokens")))
    return cut.withColumns({"n_tokens": F.coalesce(F.element_at("prefix_tokens", F.when(F.size("prefix_tokens") > 0, -1)), F.lit(0)).cast("long"), "n_bytes": F.octet_length("text").cast("long")})
