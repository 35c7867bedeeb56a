import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import counts, queries

ODD = ["a", "l", "'", "'ll", "'ve", "'re", "'s", " ", "  ", "\n", "\t", " the", "!!", "<|", "<|endoftext|>", "endoftext", "12", "é", "ß", "☃", " ", "🙂", "　", "日本", "\U00018d80", "ve", "<|endof", "|>", "\x1c", "՘"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(counts.default_model())
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return counts.Merges.load(counts.default_model())


def test_every_prefix_counts_as_the_library_encodes_it(merges, library):
    known, dice = counts.Texts(merges, 1_000_000), random.Random(7)
    texts = ["".join(dice.choice(ODD) for _ in range(dice.randint(0, 12))) for _ in range(400)]
    texts += ["".join(dice.choice("abcdefghij") for _ in range(80)) for _ in range(20)] + ["", "-" * 300, " " * 200 + "x"]
    totals, arrays = known.count(texts, True)
    for text, total, got in zip(texts, totals, arrays, strict=True):
        want = library([text[:i] for i in range(1, len(text) + 1)])
        assert list(got) == want and total == (want[-1] if want else 0), text
    assert list(known.count(texts)[0]) == list(totals)


def test_forgetting_words_changes_nothing(merges, library):
    texts = [f"word{i} again {i * 7919}" for i in range(300)]
    small = counts.Texts(merges, 2000)
    assert [int(small.count([x])[0][0]) for x in texts] == library(texts)


def test_one_very_long_word(merges, library):
    text = "ab" * 100_000
    assert counts.Texts(merges, 1_000_000).count([text])[0].tolist() == library([text])


def test_prefixes_answer_budgets_and_cuts(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "It'll be  fine, señor 🙂", "z"), (3, "It'll be  fine, señor 🙂", "z"), (4, "a <|endoftext|> b", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = counts.prefix_counts(docs).cache()
    for r in counted.collect():
        text = r.text or ""
        assert list(r.prefix_tokens) == library([text[:i] for i in range(1, len(text) + 1)])
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), (r.prefix_tokens or [0])[-1])
    for limit in range(12):
        for r in counted.select("text", counts.fitting(F.col("prefix_tokens"), F.lit(limit)).alias("k")).collect():
            text = r.text or ""
            assert r.k == max([i for i in range(1, len(text) + 1) if library([text[:i]])[0] <= limit], default=0)
        for r in counts.truncated(counted, limit).collect():
            assert r.n_tokens == library([r.text])[0] <= limit and r.n_bytes == len(r.text.encode())
    at = counted.select("text", *(counts.count_at(F.col("prefix_tokens"), F.lit(i)).alias(f"c{i}") for i in (0, 3, 999))).collect()
    assert all([r.c0, r.c3, r.c999] == [0, *library([(r.text or "")[:3], r.text or ""])] for r in at)
    assert counts.prefix_counts(docs.limit(0)).count() == 0


def test_query_equals_the_library_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, n in zip(texts, library(list(texts.values())), strict=True):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(texts[i].encode()), n > 1024)
