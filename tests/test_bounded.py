import pyarrow as pa
from pyspark.sql import functions as F

from textloom.operators import nlp, tokenindex, web
from textloom.sources import wikitext


def test_sentences_are_given_a_bounded_number_of_tokens_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(nlp, "MOST_TOKENS", 5)
    monkeypatch.setattr(nlp, "FEW", 2)
    tagger = nlp.Tagger({"the": "DT"})
    docs = spark.createDataFrame([(i, f"The cat sat. The {i} dogs ran on the mat! End") for i in range(7)] + [(7, None), (8, "")], "doc_id long, text string").coalesce(1)
    want = docs.select("doc_id", F.posexplode(nlp.parser(tagger)("text")).alias("sentence", "tokens")).collect()
    assert nlp.parsed_sentences(docs, tagger).collect() == want
    assert len(want) == 21


def test_positions_of_a_term_are_made_where_its_sentence_is(monkeypatch):
    monkeypatch.setattr(tokenindex, "FEW", 2)
    kind = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("sentence", pa.int32()), ("terms", pa.list_(pa.list_(pa.string())))])
    rows = [{"part": 0, "doc_id": i, "sentence": 0, "terms": [["a", "b"], ["a"], [], ["b", "a"]]} for i in range(3)] + [{"part": 1, "doc_id": 9, "sentence": 2, "terms": []}]
    out = [r for b in tokenindex._positions(iter([pa.RecordBatch.from_pylist(rows, kind)])) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["term"], r["positions"]) for r in out) == sorted((i, t, p) for i in range(3) for t, p in (("a", [0, 1, 3]), ("b", [0, 3])))


def test_a_text_without_signs_is_not_cut_into_tokens(spark):
    s = nlp.Sentiment({"very": (0.2, 0.3, 1.3), "so bad": (-0.8, 0.8, 1.0)})
    texts = ["plain words", "So BAD!", "it is :-( now", "(!) well", "every day", None, "not VERY"]
    want = [s.score([w for x in nlp.tokenize(t or "") for w in x]) for t in texts]
    assert not any(x in "plain words" for x in s.signs()) and nlp.Sentiment({"é": (1.0, 1.0, 1.0)}).signs() is None
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", s.udf()("t").alias("s")).orderBy("i").collect()
    assert [(r.s.polarity, r.s.subjectivity) for r in got] == want


def test_links_and_sections_are_made_of_a_few_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(web, "FEW", 2)
    monkeypatch.setattr(wikitext, "FEW", 2)
    pages = pa.array([f'<a href="/{i}">x</a>' for i in range(5)] + [None])
    got = web.links.func(pages, pa.array(["http://a.org/"] * 6))
    assert [[x["url"] for x in r] for r in got.to_pylist()] == [[f"http://a.org/{i}"] for i in range(5)] + [[]]
    parts = wikitext.sections.func(pa.array(["a\n== b ==\nc", None, "d"]))
    assert [[x["title"] for x in r] for r in parts.to_pylist()] == [["", "b"], [""], [""]]
    assert len(web.links.func(pages.slice(0, 0), pages.slice(0, 0))) == 0
