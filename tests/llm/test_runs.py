import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from textloom.llm import queries, runs


def brute(words: list, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                s, length = i, j + q - i
                part = words[s : s + length]
                if length >= max(shortest, exponent * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                    out.append((s, length, q))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def text_of(dice: random.Random) -> str:
    out = []
    for _ in range(dice.randint(0, 5)):
        block = [dice.choice("abcAB") for _ in range(dice.randint(1, 9))]
        out += block * dice.choice([1, 1, 3, 4, 5, 9]) + block[: dice.randint(0, len(block))]
    return dice.choice([" ", "\t", "  "]).join(out)


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(5)
    return [None, "", " \n ", "a", "a a a a a a", "A a a a a a a", "a b a b a b", "a b a b a b a b", "x " * 500, "y z " * 300] + [text_of(dice) for _ in range(150)]


@pytest.mark.parametrize("long_text", [4_000_000, 40])
def test_runs_equal_brute_force(spark, texts, long_text):
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(4, texts[4], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = runs.find_runs(docs, long_text=long_text).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows)
    for r in got:
        words = (texts[r.doc_id] or "").split()
        want = brute(words)
        assert [tuple(x) for x in r.runs] == want, texts[r.doc_id]
        assert r.collapsed == collapsed(words, want)
    assert runs.find_runs(docs.limit(0), long_text=long_text).count() == 0


def test_other_exponents_and_lag_ranges():
    dice = random.Random(9)
    for _ in range(60):
        words = text_of(dice).split()
        ids = np.array([ord(w) for w in words], np.uint64)
        first = np.array([0, len(words)])
        for exponent, shortest in ((2, 2), (3, 6), (4, 6)):
            want = brute(words, exponent, shortest)
            assert runs.scan(ids, first, exponent, shortest)[0] == want
            parts = [runs.scan(ids, first, exponent, shortest, lo, lo + 3)[0] for lo in range(1, len(words) + 1, 3)]
            assert sorted(x for p in parts for x in p) == want


def test_a_long_text_that_repeats_all_along_takes_little():
    for block in (1, 7):
        ids = np.tile(np.arange(block, dtype=np.uint64), 200_000 // block)
        assert runs.scan(ids, np.array([0, len(ids)]), 4, 6) == [[(0, len(ids), block)]]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == texts.keys()
    with_runs = 0
    for i, text in texts.items():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
        with_runs += bool(found)
    assert with_runs > 10
