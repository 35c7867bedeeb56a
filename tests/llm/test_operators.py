"""Odd rows, empty tables and brute-force versions of the operators that have no test file of their own."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, decontaminate, mixing, pieces, quality, topk, urls

TEXTS = [None, "", " ", "\n", "a", "The cat sat on the mat. The cat!", "the cat\n\nsat  on\ta mat ", "x" * 5000, "é 😀 ▁ \u0000 z", "one two three four five six seven"]


def docs(spark, extra=()):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1), (None, "no id here", 2), *extra]
    return spark.createDataFrame(rows, "doc_id long, text string, block int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# LM scoring


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_lm_base_scores_match_brute_force(spark):
    df = docs(spark)
    rows = [tuple(r)[:2] for r in df.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts: dict = {}
    for d, t in rows:
        if not held(d):
            for w in [*tokens(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, held(d), len(tokens(t)) + 1, sum(counts.get(w, 0) > 0 for w in [*tokens(t), None]), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*tokens(t), None]), 6)) for d, t in rows)
    got = mixing.scores(df, block_docs=4).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert mixing.scores(empty(spark)).collect() == []


def test_lm_learns(spark):
    r = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(60)] + [(100 + i, "".join(r.choice("qwxzjk vb") for _ in range(300))) for i in range(20)]
    got = {x["doc_id"]: x for x in mixing.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    like = [x["bits_per_byte"] for d, x in got.items() if d < 100 and x["held_out"]]
    noise = [x["bits_per_byte"] for d, x in got.items() if d >= 100 and x["held_out"]]
    assert max(like) < 1.5 < 2.0 < min(noise)


def test_unit_costs_are_a_distribution():
    """Over all continuations of a prefix the probabilities of the next byte sum to 1."""
    import pyarrow as pa

    model = mixing.Model(np.zeros((mixing.ORDERS, 2 << 20), np.int32))
    units = pa.array([chr(b) for b in range(1, 128)])
    e = mixing.Events(units, np.zeros((127, 4), np.int64))
    p = np.ones(len(e.byte))
    for j in range(8):
        x, gate = model.inputs(e, j, False)
        q = model.refined(model.mixed(x, gate), gate)
        p *= np.where(e.bit(j) == 1, q, 1 - q)
    first = p[e.at][e.term < 0]
    assert first.sum() == pytest.approx(127 / 256, rel=0.2)


# quality classifier


def test_quality_held_out_and_odd_rows(spark):
    r = random.Random(2)
    good = [" ".join(r.choice("sun moon star sky sea land wind rain".split()) for _ in range(r.randint(5, 200))) for _ in range(300)]
    bad = ["$$$ ### " * r.randint(10, 40) + r.choice(["%%%", "!!!"]) for _ in range(150)]
    toxic = [t + " " + " ".join(["idiot scum"] * 2) for t in good[:150]]
    rows = [(i, t, 0 if t in bad else 1, int("idiot" in t)) for i, t in enumerate(good + bad + toxic)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    train = df.where("doc_id % 2 = 0")
    model = quality.train(df.select("doc_id", "text"), train.select("doc_id", "quality", "toxic"))
    kept = {x["doc_id"]: x["keep"] for x in quality.score(df, model).collect()}
    test = [(i, q == 1 and not t) for i, _, q, t in rows if i % 2]
    assert sum(kept[i] == y for i, y in test) > 0.95 * len(test)
    assert np.all(np.diff(model.thresholds) > 0)
    odd = docs(spark)
    assert quality.score(odd, model).count() == 12 and quality.select(odd, model).columns == odd.columns
    assert quality.score(empty(spark), model).collect() == []
    none = spark.createDataFrame([(1, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.select(odd, quality.train(odd, none)).count() == 12


# chat


def test_chat_folds_events_and_renders(spark):
    log = [
        (1, 0, 1, 1, "message", "user", "hi"), (1, 1, 2, 1, "delta", "assistant", "wro"), (1, 1, 2, 2, "delta", "assistant", "ng"), (1, 1, 2, 3, "regenerate", "assistant", "x"),
        (1, 1, 2, 5, "delta", "assistant", "<|im_end|>\n"), (1, 1, 2, 4, "delta", "assistant", "right &amp; "), (1, 1, 2, 4, "delta", "assistant", "right &amp; "), (1, 2, 3, 1, "message", "user", None), (1, 2, 3, 2, "edit", "user", "bye"),
    ]
    df = spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    out = chat.render(chat.fold(df)).select("formatted", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted")).alias("loss")).first()
    assert [tuple(t) for t in out["t"]] == [("user", "hi"), ("assistant", "right &amp; <|im_end|>\n"), ("user", "bye")]
    assert out["loss"] == "right &amp; <|im_end|>\n" and out["formatted"].count("<|im_end|>") == 3


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 0, "assistant", "a<|b&lt;|"), (2, None, "as\nsistant", "<"), (2, 1, "assistant", "|im_start|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.events_of(df)))).collect()}
    assert (got[1]["n_turns"], got[None]["loss_chars"], got[2]["n_turns"], got[2]["loss_chars"]) == (2, 9, 2, 11)
    assert chat.digests(chat.render(chat.fold(chat.events_of(df.limit(0))))).collect() == []


# decontamination


def test_decontamination_matches_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 20, 50])))) for i in range(30)] + [(30, None), (31, " "), (0, "again the same id")]
    texts = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 10, 300]))]
        if i % 2:
            passage = items[i // 2][1].split()
            if i % 4 == 1 and len(passage) > 10:
                passage[r.randrange(len(passage))] = "edited"
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append((i, " ".join(words)))
    grams = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    want = set()
    for j, t in items:
        q = tokens(t)
        if q:
            k = min(5, len(q))
            g = grams(q, k)
            want |= {(d, j, len(g & grams(tokens(x), k))) for d, x in texts if 100 * len(g & grams(tokens(x), k)) >= 75 * len(g)}
    d, b = spark.createDataFrame([(*x, 0) for x in texts], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 300):
        got = {(x["doc_id"], x["item_id"], x["shared"]) for x in decontaminate.contaminated(d, b, bound=bound).collect()}
        assert got == want
    clean = decontaminate.clean(d, b, bound=300)
    assert {x["doc_id"] for x in clean.collect()} == {x[0] for x in texts} - {x[0] for x in want} and clean.columns == d.columns
    assert decontaminate.contaminated(empty(spark), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.clean(docs(spark), b.limit(0)).count() == 12


# SentencePiece


def test_pieces_equal_the_library_and_round_trip(spark):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(4)
    extra = [(100 + i, "".join(r.choice("abcdeghinorst  \nT.,é") for _ in range(r.randint(1, 400))), 0) for i in range(60)]
    out = pieces.encode(docs(spark, extra), text=True).collect()
    assert all(x["round_trip"] and x["n_pieces"] == len(x["ids"]) for x in out)
    assert all(x["ids"] == lib.encode(x["text"] or "") for x in out if "▁" not in (x["text"] or ""))
    back = pieces.decode(pieces.encode(docs(spark))).collect()
    assert sorted(x["text"] for x in back) == sorted([t or "" for t in TEXTS] + [TEXTS[5], "no id here"])
    assert pieces.encode(empty(spark)).collect() == []


def test_unigram_models_take_the_best_sum_of_scores():
    v = pieces.Vocabulary({" ": 0, "a": 1, "b": 2, "ab": 3, " a": 4, "ba": 5}, {" ": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, " a": -2.2, "ba": -1.0}, list(range(256)), False, True, [b" ", b"a", b"b", b"ab", b" a", b"ba"])
    got = dict(pieces.Encoder(v).encode_sorted(sorted([" aba", " ab", " a"])))
    ids = lambda w: np.frombuffer(got[w], np.int32).tolist()
    assert ids(" a") == [4] and ids(" ab") == [0, 3] and ids(" aba") == [4, 5]


def test_only_what_may_still_become_a_piece_is_looked_up():
    asked = []

    class Ids(dict):
        def __contains__(self, piece):
            asked.append(piece)
            return super().__contains__(piece)

    names = ["a", "b", "ab", "bbbbbbbbbbbb"]
    v = pieces.Vocabulary(Ids({p: i for i, p in enumerate(names)}), dict.fromkeys(names, -1.0) | {"ab": -0.5}, list(range(256)), True, False, [p.encode() for p in names])
    got = dict(pieces.Encoder(v).encode_sorted(["ab" * 200, "ab" * 200 + "x", "b"]))
    assert [np.frombuffer(x, np.int32).tolist() for x in got.values()] == [[2] * 200, [2] * 200 + [ord("x")], [1]]
    assert len(asked) < 700  # 400 ends, 12 possible beginnings each


def test_pieces_are_looked_up_once_for_an_end_not_at_every_place():
    asked = []

    class Ids(dict):
        def __contains__(self, piece):
            asked.append(piece)
            return super().__contains__(piece)

    r = random.Random(6)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb"]
    v = pieces.Vocabulary(Ids({p: i for i, p in enumerate(names)}), {p: -float(i // 2) for i, p in enumerate(names)}, list(range(256)), True, False, [p.encode() for p in names])
    words = sorted({"".join(r.choice("abcx") for _ in range(r.randint(1, 40))) for _ in range(500)})
    one = pieces.Encoder(v)
    got = dict(one.encode_sorted(words))
    assert len(asked) <= sum(map(len, one.begins))  # the ends of each beginning of a piece, however long the words are
    for most in (0, 5):  # what isn't kept is found anew
        few = pieces.Encoder(v, most)
        assert dict(few.encode_sorted(words)) == got and few.kept <= most


def test_two_pieces_follow_if_merging_gives_them_back():
    def merged(s, scores):
        parts = list(s)
        while True:
            best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores), default=None)
            if best is None:
                return parts
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]

    r = random.Random(7)
    for _ in range(60):
        names = sorted({"a", "b"} | {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(15)})
        scores = {p: -float(r.randint(0, 8)) for p in names}
        one = pieces.Encoder(pieces.Vocabulary({p: i for i, p in enumerate(names)}, scores, list(range(256)), True, False, [p.encode() for p in names]))
        assert all(one.apart(x, y) == (merged(x + y, scores) == [x, y]) for x in names for y in names)


# URL filters


def test_url_filters_at_the_borders(spark):
    e = spark.createDataFrame([("l", "block", "domain", "b.com", "add", "2024-01-02"), ("l", "block", "domain", "b.com", "remove", "2024-01-04"), ("l", "allow", "prefix", "a.b.com/x/", "add", "2024-01-03"), ("l", "block", "host", None, "add", "2024-01-01")], "list_id string, policy string, kind string, rule string, action string, dated string").withColumn("dated", F.to_timestamp("dated"))
    c = [(1, "http://a.b.com/x/1", 1), (1, "http://a.b.com/x/1", 2), (1, "http://a.b.com/x/1", 3), (1, "http://a.b.com/x/1", 4), (2, "http://ab.com/", 2), (3, None, 2), (4, "nonsense", 2), (5, "http://B.com", None), (1, "http://a.b.com/x/1", 2)]
    df = spark.createDataFrame(c, "page_id long, url string, d int").withColumn("fetched_at", F.to_timestamp(F.format_string("2024-01-%02d", "d")))
    df = df.withColumn("fetched_at", F.when(F.col("d").isNotNull(), F.col("fetched_at")))
    got = sorted((r["page_id"], r["fetched_at"].day if r["fetched_at"] else 0, r["n_active"], r["blocked"]) for r in urls.evaluate(df, e).collect())
    assert got == [(1, 1, 0, False), (1, 2, 1, True), (1, 3, 2, False), (1, 4, 1, False), (2, 2, 0, False), (3, 2, 0, False), (4, 2, 0, False), (5, 0, 0, False)]
    assert urls.evaluate(df.limit(0), e).collect() == [] and not any(r["blocked"] for r in urls.evaluate(df, e.limit(0)).collect())


# top-k


def test_top_k_matches_brute_force(spark):
    g = np.random.default_rng(5)
    rows = [(i, [float(x) for x in g.normal(size=8)]) for i in range(200)] + [(300 + i, [1.0] * 8) for i in range(60)] + [(50, [0.5] * 8)]
    rows += [(400, None), (401, []), (402, [1.0, None] * 4), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, [1.0] * 8), (450, [1.0, 2.0]), (451, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table = topk.integers(df, 256)
    valid = [(r["vec_id"], r["v"]) for r in table.collect()]
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 50 = 0"), block_bytes=600).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, _ in valid if i % 50 == 0}:
        asks = [v for i, v in valid if i == q]  # two rows share id 50
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for v in asks for i, w in valid if i != q and len(w) == len(v))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(table.limit(0), table.limit(0)).collect() == []


def test_top_k_of_large_numbers_and_clashing_names(spark):
    big = [(i, [2.0**40 + i, -(2.0**20) * i, 1.0], 1) for i in range(60)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, score int")
    table = topk.integers(df, 1)
    with pytest.raises(ArithmeticError):
        topk.top_k(topk.integers(df, 2**22), table)
    half = topk.integers(df.withColumn("embedding", F.transform("embedding", lambda x: x / 2**12)), 1)  # sums beyond 2**53
    vectors = {r["vec_id"]: r["v"] for r in half.collect()}
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(half, half.where("vec_id % 50 = 0")).collect()]
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], w, strict=True)), i) for i, w in vectors.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(got) == want


def test_a_megabyte_in_one_word(spark):
    text = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(330_000)) + "é" * 3
    df = spark.createDataFrame([(1, text), (2, "x" * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode(df).collect()}
    assert got[1]["round_trip"] and got[2]["round_trip"] and got[1]["n_pieces"] == len(got[1]["ids"]) > 0
    assert {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame([(1, got[1]["ids"]), (3, None), (4, [])], "doc_id long, ids array<int>").withColumn("text", F.lit(7))).collect()} == {1: text, 3: "", 4: ""}


def test_quality_learns_from_few_ratings(spark):
    rows = [(i, f"alpha{i % 7} beta{i % 5} gamma " + ("awful nasty" if i % 2 else "kind gentle")) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    kept = {r["doc_id"] for r in quality.select(df, quality.train(df, labels)).collect()}
    assert kept == {i for i in range(80) if i % 2 == 0}
