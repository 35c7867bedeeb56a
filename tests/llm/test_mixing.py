import random

import numpy as np
import pyarrow as pa

from textloom.llm import mixing
from textloom.llm.words import words_of


def brute(words):
    """(run, hit) of each word of one text, by looking back."""
    out = []
    for i in range(len(words)):
        q = next((j for j in range(i - 2, -1, -1) if words[j] == words[i - 1]), -1) if i else -1
        run = 0
        while q >= 0 and run < 3 and q - run >= 0 and words[q - run] == words[i - 1 - run]:
            run += 1
        out.append((run, q >= 0 and words[q + 1] == words[i]))
    return out


def test_echoes_match_brute_force():
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(r.choice([0, 1, 2, 5, 60]))) for _ in range(80)]
    run, hit = mixing.echoes(words_of(pa.array(texts)))
    assert list(zip(run.tolist(), hit.tolist(), strict=True)) == [x for t in texts for x in brute(t.split())]
    owner, rates = words_of(pa.array(texts)).owner(), np.array([0.5, 0.2, 0.6, 0.9])
    want = []
    for t in texts:
        seen, hits = [0] * 4, [0] * 4
        for k, h in brute(t.split()):
            p = min(max((hits[k] + 4 * rates[k]) / (seen[k] + 4), 1e-4), 1 - 1e-4)
            want.append(0.0 if k == 0 else -np.log2(p if h else 1 - p))
            seen[k], hits[k] = seen[k] + 1, hits[k] + h
    assert np.allclose(mixing.echo_bits(run, hit, owner, rates), want)
    assert mixing.echoes(words_of(pa.array(["", None])))[0].tolist() == []


def test_order_counts_and_dealing_does_not(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(60)]
    phrase = " ".join(words[:10])
    shuffled = " ".join(r.sample((phrase + " " + phrase).split(), 20))
    rows += [(100, phrase + " " + phrase), (101, shuffled), (102, "a\x00b a\x01b"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {x["doc_id"]: x for x in mixing.scores(df.repartition(1)).collect()}
    many = {x["doc_id"]: x for x in mixing.scores(df.repartition(7), block_docs=9).collect()}
    assert one[100]["score"] > one[101]["score"] + 2
    assert all(abs(one[i]["score"] - many[i]["score"]) < 1e-6 for i in one) and all(one[i]["score"] <= 0 for i in one)
