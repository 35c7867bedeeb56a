import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from textloom.llm import phrases, queries


def brute(rows: list[tuple], least: int, most: int) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + m] for g, a in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if a >= counts[g[i : i + m]]}
        rows = []
        for g, a in found.items():
            if g not in gone:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, g.decode(), -a, left, right, n[lang], -score) for i, (score, a, g, left, right) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(3)
    words = [chr(97 + i) * (1 + i % 3) for i in range(14)] + ["É", "it's", "日本"]
    out = [(None, "en"), ("", None), (" .,\n", "de"), ("Only once here", "fr")]
    for _ in range(300):
        text = []
        for _ in range(dice.randint(1, 12)):
            text += dice.choice([["New", "York", "city"], ["of", "the"], ["b", "b", "b", "b", "b", "b"], [dice.choice(words)], [f"rare{dice.random()}"]]) + [dice.choice(["", "", ".", "!\n", ","])]
        out.append((" ".join(text), dice.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize(("least", "bound", "block_keys"), [(5, 64_000_000, 1 << 20), (3, 500, 16), (300, 64_000_000, 1 << 20)])
def test_collocations_equal_brute_force(spark, rows, least, bound, block_keys):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, score string").repartition(3)
    got = phrases.collocations(docs, least, 40, bound, block_keys)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 40)


def test_nothing_frequent_and_empty_tables(spark):
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_the_hash_is_minimal_perfect_and_verified():
    dice = np.random.default_rng(1)
    keys = np.unique(dice.integers(1, 2**63, 50_000, dtype=np.uint64))
    h = phrases.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert (h.stored[h.slots(keys)] == keys).all()
    others = dice.integers(1, 2**63, 50_000, dtype=np.uint64)
    assert (h.slots(others[~np.isin(others, keys)]) == -1).all()
    again = phrases.PerfectHash.build(h.stored)  # slots don't depend on the order
    assert (again.slots(keys) == h.slots(keys)).all()
    assert len(phrases.PerfectHash.build(np.empty(0, np.uint64)).slots(keys)) == len(keys)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP12_SQL).fetchall()
    assert want and sorted(want) == sorted(map(tuple, queries.op12_phrase_collocations(spark, sf).collect()))


def test_arrays_of_several_chunks(spark):
    def rows(batches):
        for _ in batches:
            counts = phrases.Sparse(200_000, 1 << 62)
            counts.n[[0, 65_535, 65_536, 199_999]] = [1, 2, 3, 1 << 40]
            yield from counts.rows()

    total = np.zeros(200_000, np.int64)
    for r in phrases._summed(spark.range(5, numPartitions=3).mapInArrow(rows, phrases.SUMS), 1 << 62).collect():
        total[phrases._indices(r.chunk, r["at"])] = np.frombuffer(r.n, np.uint64).astype(np.int64)
    assert total[[0, 65_535, 65_536, 199_999]].tolist() == [3, 6, 9, 3 << 40] and np.count_nonzero(total) == 4
