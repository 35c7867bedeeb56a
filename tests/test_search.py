import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import inflect, matcher, nlp, tokenindex
from textloom.plans.q_text import LEXICON
from textloom.sources import search


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    return {i: " ".join(dice.choices(words, [1 / (k + 1) for k in range(30)], k=dice.randint(0, 60))) for i in range(-3, 400)}


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "i")
    rows = [*corpus.items(), (1000, None), (None, "w0 w1")]
    search.build_index(spark.createDataFrame(rows, "doc_id long, text string"), at, shards=3, buckets=4)
    return at


def scores(corpus: dict[int, str], query: str, every: bool) -> list[tuple[int, int]]:
    tf = {i: Counter(t.split()) for i, t in corpus.items()}
    n, out = len(corpus) + 1, []
    asked = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    df = {t: sum(t in c for c in tf.values()) for t in asked}
    for i, c in tf.items():
        have = [t for t in asked if c[t]]
        if have and (not every or len(have) == len(asked)):
            out.append((-sum(1000 * min(c[t], 15) // (min(c[t], 15) + 1) * (1 + (n // df[t]).bit_length()) for t in have), i))
    return [(i, -s) for s, i in sorted(out)]


@pytest.mark.parametrize("query", ["w0", "w3 W29!", "w1 w2 w5 w28", "w0 nowhere", "nowhere", ""])
@pytest.mark.parametrize("kind", ["any", "all"])
def test_pages_equal_full_scoring(spark, corpus, index, query, kind):
    want = scores(corpus, query, kind == "all")
    for start, count in ((1, 5), (3, 7), (90, 5)):
        got = [tuple(r) for r in search.search(spark, index, query, start, count, kind).orderBy("rank").collect()]
        page = want[(start - 1) * count : start * count]
        assert got == [((start - 1) * count + k, *x) for k, x in enumerate(page, 1)]
    got = search.search(spark, index, query, 1, 6, kind, sort="id").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in want)[:6]


def test_filters_go_into_the_source(spark, corpus, index):
    search.searcher(spark)
    load = lambda: spark.read.format("textloom_search").options(path=index, query="w3 w9", count="1000").load()
    want = dict(scores(corpus, "w3 w9", False))
    every = load().collect()
    assert {r.doc_id: r.score for r in every} == want
    least = sorted(want.values())[len(want) // 2]
    some = load().where(f"score > {least} AND shard IN (0, 2)")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert f"> {least}" not in plan(some) and "> 7" in plan(load().where("scored > 7"))  # only what wasn't pushed is left to filter
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in every if r.score > least and r.shard != 1} != set()
    assert some.rdd.getNumPartitions() == 2
    assert {r.doc_id: r.score for r in load().where("doc_id IN (5, 6, 7)").collect()} == {i: s for i, s in want.items() if i in (5, 6, 7)}
    with pytest.raises(Exception, match="type is any or all"):
        spark.read.format("textloom_search").options(path=index, type="some").load().count()


def test_few_documents_are_scored(spark, index, corpus):
    page = spark.read.format("textloom_search").options(path=index, query="w29 w0", count="3").load()
    scored = {r.shard: r.scored for r in page.collect()}
    assert sum(scored.values()) < len(scores(corpus, "w29 w0", False)) * 0.7


def test_index_and_scan_give_the_same_matches(spark, tmp_path):
    texts = ["The cat sat on the mat. A dog was here.", "She is big and the cats sat with it.", "", None, "Cat cat CAT on on the the mat! The big cat of the mat sat.", "No such thing"] * 3
    run = nlp.parser(nlp.Tagger(LEXICON), inflect.find_lemma)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    at = str(tmp_path / "tokens")
    tokenindex.build(docs.select("doc_id", run("text").alias("parsed")), at, buckets=3)
    total = spark.read.parquet(f"{at}/sentences").count()
    for text in ("the cat", "cat on the", "{NP} IN {NP}", "NP VP", "cat|dog sat|was", "big? cat+ on", "JJ+ NN", "mat !cat", "c*t sat", "(the) mat", "^the NN", "nothing at all", "NP", "cat VBD on"):
        e = matcher.Expression(text)
        want = sorted(map(str, tokenindex.scan(spark, at, e).collect()))
        assert sorted(map(str, tokenindex.search(spark, at, e).collect())) == want, text
        maybe = tokenindex.candidates(spark, at, e)
        assert maybe.count() <= total and maybe.distinct().count() == maybe.count()
    assert tokenindex.candidates(spark, at, matcher.Expression("cat on the")).count() < total / 2
    assert [p.after for p in tokenindex.probes(matcher.Expression("the cat? sat on"))] == [None, None, 1]
    plan = tokenindex.candidates(spark, at, matcher.Expression("the cat"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [w:cat,w:the])]" in plan
    assert spark.read.parquet(f"{at}/postings").where(F.size("positions") == 0).count() == 0
