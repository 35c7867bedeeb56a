import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.llm.neardup import _least_need, _need, link_components, survivors
from textloom.llm.words import distinct, shingles_of, words_of


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, t=75):
    sets = [(d, shingles(x)) for d, x in rows]
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, z in sets[:i]:
            if s and z and 100 * len(s & z) >= t * len(s | z):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(50)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.5:
            words = (r.choice(rows)[1] or "").split()
            for _ in range(r.randint(0, 1 + len(words) // 20)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            words = words[: r.randint(len(words) * 3 // 4, len(words))]
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 30, 200]))]
            if r.random() < 0.4:
                words += passage
        rows.append((i, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    return rows + [(n, None), (n + 1, "\t \n"), (n + 2, "long " * 5000)]


def test_components_match_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(d, x, 7, "n") for d, x in rows], "doc_id long, text string, n int, s1 string")
    assert sorted(tuple(r) for r in link_components(df).collect()) == brute(rows)


def test_large_group_of_near_copies_and_chain(spark):
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :])) for i in range(80)]
    chain = [f"c{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(chain[i * 10 : i * 10 + 100])) for i in range(20)]
    got = sorted(tuple(r) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    a, b = "a b c d e f g", "k l m n o p q"
    rows = [(5, a), (5, b), (7, b), (3, a), (3, a), (9, "z")]
    got = sorted(tuple(r) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, 3), (3, 3, 3), (5, 3, 3), (5, 3, 3), (7, 3, 3), (9, 1, 9)]
    assert link_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids_and_two_near_sizes_under_one_id(spark):
    words = [f"w{i}" for i in range(120)]
    a, b, c = (" ".join(words[i:j]) for i, j in ((0, 100), (0, 102), (2, 104)))
    alone = " ".join(f"x{i}" for i in range(50))
    rows = [(5, a), (5, b), (9, c), (None, " ".join(words[:98])), (None, alone), (None, alone + " y"), (7, "q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(-1 if v is None else v for v in r) for r in link_components(df).collect()))
    assert got == [(-1, 0, -1), (-1, 46, -1), (-1, 47, -1), (-1, 94, 5), (5, 96, 5), (5, 98, 5), (7, 1, 7), (9, 98, 5)]
    kept = survivors(df.withColumn("h", F.lit("x")).withColumn("rid", F.lit(1)).withColumn("a.b", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "h", "rid", "a.b"]
    got = sorted(((r["doc_id"] or -1), (r["text"] or "")) for r in kept.collect())
    assert len(got) == 5 and got[0] == (-1, "") and got[1][1] in (alone, alone + " y") and got[2:] == [(5, a), (5, b), (7, "q")]


def test_many_texts_just_below_the_threshold_of_each_other(spark):
    base, r = [f"b{i}" for i in range(104)], random.Random(3)
    rows = [(i, " ".join(f"e{i}_{j}" if j in cut else w for j, w in enumerate(base))) for i in range(150) for cut in [set(r.sample(range(104), 4))]]
    got = sorted(tuple(x) for x in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_group_whose_second_largest_member_needs_fewer_tokens(spark):
    words = [f"w{i}" for i in range(49)]
    values, owner = distinct(*shingles_of(words_of(pa.array(words)), 1))
    words = [words[owner[i]] for i in values.argsort()]  # in the order of the index
    own, theirs, more, both = words[:5], words[5:12], words[12:13], words[13:]
    a, b = " ".join(theirs + both), " ".join(theirs + more + both)
    rows = [(1, a), (2, b), (3, a), (3, b), (4, " ".join(own + both))]  # 3 ties 43 and 44 into a group; 41 links with 43 at just 75 %
    got = sorted(tuple(r) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, rounds=0).collect())
    assert got == [(1, 43, 1), (2, 44, 1), (3, 43, 1), (3, 44, 1), (4, 41, 1)]


def test_bound_of_a_group_is_the_least_of_its_sizes(spark):
    n, low, size, m = F.col("n"), F.col("low"), F.col("size"), F.col("m")
    sizes = spark.range(1, 200).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.ceil(n * 0.75), F.floor(n / 0.75))).alias("low"))
    sizes = sizes.select("n", "low", F.explode(F.sequence(low, F.least(low + 12, F.floor(n / 0.75)))).alias("size"))
    every = sizes.select("n", "low", "size", F.explode(F.sequence(low, size)).alias("m"))
    want = every.groupBy("n", "low", "size").agg(F.min(F.least(_need(n, m, 75), _need(m, n, 75))).alias("want"))
    assert want.where(F.col("want") != _least_need(n, low, size, 75)).count() == 0
