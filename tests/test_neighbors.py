import math
import random

import pyarrow as pa

from textloom.operators import vector


def _cosine(a: dict, b: dict) -> float:
    dot = sum(a[t] * b[t] for t in sorted(a) if t in b)
    return dot / math.sqrt(sum(x * x for x in a.values())) / math.sqrt(sum(x * x for x in b.values()))


def test_blocks_give_the_neighbours_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_DOCS", 7)
    monkeypatch.setattr(vector, "BLOCK_TERMS", 60)
    r = random.Random(3)
    docs = {i: {f"t{r.randrange(30)}": float(r.randrange(1, 5)) for _ in range(r.randrange(1, 9))} for i in range(40)}
    docs |= {i: dict(docs[2]) for i in range(40, 52)} | {60: {"apart": 1.0}}
    v = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()], "doc_id long, term string, w double")
    rows = vector.neighbors(v, v.where("doc_id % 2 = 0"), 3).collect()
    want = []
    for q in (i for i in docs if i % 2 == 0):
        near = sorted((-round(_cosine(docs[q], d), 9), i) for i, d in docs.items() if i != q and set(d) & set(docs[q]))[:3]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(near, 1)]
    got = [(x.query_id, x.rank, x.doc_id, round(x.similarity, 9)) for x in rows]
    assert sorted((q, k, s) for q, k, _, s in got) == sorted((q, k, s) for q, k, _, s in want)
    # of equal vectors the smallest ids come first
    assert [i for q, _, i, _ in sorted(got) if q == 50] == [2, 40, 41]


def test_copies_beyond_the_best_are_left_out_of_a_block():
    same = [{"doc_id": i, "norm": 1.0, "tids": [1], "ws": [1.0]} for i in range(500)]
    kind = pa.struct([("doc_id", pa.int64()), ("norm", pa.float64()), ("tids", pa.list_(pa.int64())), ("ws", pa.list_(pa.float64()))])
    assert vector._Vectors(pa.array(same, kind), 4).ids == [0, 1, 2, 3]
