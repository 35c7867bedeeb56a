"""Language, matcher, inflection, web and files with known answers."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import inflect, matcher, nlp, stemmer, web
from textloom.sources import files
from textloom.streaming import stateful


def test_tokenizer():
    assert nlp.tokenize("Dr. No said: \"It's fine.\" Isn't it? Yes... :-)") == [["Dr.", "No", "said", ":", '"', "It", "'s", "fine", ".", '"'], ["Is", "n't", "it", "?"], ["Yes", "..."], [":-)"]]


def test_tagger():
    assert [t for _, t in nlp.Tagger().tag(["Lindqvist", "boat", "1.0"])] == ["NNP", "NN", "CD"]
    assert nlp.Tagger(morphology=[("NN", "s", "hassuffix", "NNS")], lexicon={"oars": "NN"}).tag(["oars"]) == [("oars", "NN")]
    assert nlp.Tagger({"to": "TO", "be": "VBD"}, context=[("VBD", "VB", "PREVTAG", "TO")]).tag(["to", "be"]) == [("to", "TO"), ("be", "VB")]
    assert nlp.Tagger(entities={"lindqvist 's boat": "PERS"}).tag(["Lindqvist", "'s", "boat"])[2][1] == "NNP-PERS"


def test_chunks():
    assert nlp.chunk([("the", "DT"), ("tall", "JJ"), ("ship", "NN")]) == ["B-NP", "I-NP", "I-NP"]
    assert nlp.chunk([("la", "DT"), ("casa", "NN"), ("blanca", "JJ")], romance=True) == ["B-NP", "I-NP", "I-NP"]
    assert nlp.chunk([("the", "DT"), ("ship", "NN"), ("tall", "JJ")])[2] == "B-ADJP"
    tagged = [("a", "DT"), ("dog", "NN"), ("lay", "VBD"), ("in", "IN"), ("the", "DT"), ("yard", "NN")]
    c = nlp.chunk(tagged)
    assert nlp.prepositions(c) == ["O", "O", "O", "B-PNP", "I-PNP", "I-PNP"]
    assert nlp.relations(tagged, c, nlp.prepositions(c))[:3] == ["NP-SBJ-1", "NP-SBJ-1", "VP-1"]


def test_matcher(spark):
    lexicon = {"the": "DT", "old": "JJ", "red": "JJ", "lantern": "NN", "hung": "VBD", "over": "IN", "door": "NN"}
    run = nlp.parser(nlp.Tagger(lexicon))
    df = spark.createDataFrame([("The old red lantern hung over the door.",)], "text string").select(run("text").alias("p"))
    found = lambda s, t=None: [m["words"] for m in df.select(matcher.matches(matcher.Expression(s, t))("p").alias("m")).first()["m"]]
    assert found("lantern") == ["lantern"]
    assert found("JJ+ NN") == ["old red lantern"]
    assert found("(DT) JJ? lantern") == ["red lantern"]
    assert found("l*n|d*r") == ["lantern", "door"]
    assert found("TOOL", matcher.Taxonomy({"lantern": "tool"})) == ["lantern"]
    assert found("!DT|!JJ hung") == ["lantern hung"]
    got = df.select(matcher.matches(matcher.Expression("{JJ} {NN} VBD"))("p").alias("m")).first()["m"][0]
    assert got["groups"] == ["red", "lantern"]


def test_sentiment():
    s = nlp.Sentiment({"good": (0.8, 0.6, 1.0), "very": (0.0, 0.0, 1.5), "bad": (-0.6, 0.6, 1.0)}, modifiers=frozenset(["very"]))
    assert s.score(["good"]) == (0.8, 0.6)
    assert s.score(["not", "good"])[0] == pytest.approx(-0.4)
    assert s.score(["very", "bad"])[0] == pytest.approx(-0.9)
    assert nlp.Sentiment({}).score([":-)"]) == (1.0, 1.0)


def test_inflection():
    for single, many in {"cat": "cats", "city": "cities", "child": "children", "wolf": "wolves", "matrix": "matrices", "sheep": "sheep", "box": "boxes", "knife": "knives", "mother-in-law": "mothers-in-law"}.items():
        assert inflect.pluralize(single) == many
        assert inflect.singularize(many) == single
    assert [inflect.article(w) for w in ("onerous", "ones", "European", "umbrella", "unimportant", "UFO", "NATO", "x", "u", "heirloom", "history", "utopian", "ulterior", "one-off", "ubiquitous", "")] == ["an", "a", "a", "an", "an", "a", "an", "an", "a", "an", "a", "a", "an", "a", "a", "a"]
    assert [inflect.approximate("cat", n) for n in (0, 1, 2, 7, 17, 22, 199, 1999, 10**6 - 1, 10**6)] == ["no cats", "a cat", "a pair of cats", "several cats", "a number of cats", "around twenty cats", "dozens of cats", "hundreds of cats", "thousands of cats", "millions of cats"]
    assert [inflect.article(w) for w in ("hour", "university", "owl", "FBI", "bear", "one-liner")] == ["an", "a", "an", "an", "a", "a"]
    assert [inflect.comparative(w) for w in ("nice", "big", "happy", "expensive", "good")] == ["nicer", "bigger", "happier", "more expensive", "better"]
    assert inflect.lexeme("stop") == ["stop", "stops", "stopping", "stopped", "stopped"]
    assert [inflect.lemma(w) for w in ("gave", "stopping", "lying", "studies", "walked")] == ["give", "stop", "lie", "study", "walk"]
    assert inflect.conjugate("be", "present", 3) == "is" and inflect.tenses("took") == ["past"]
    assert inflect.numerals(2385.25) == "two thousand, three hundred and eighty-five point two five" or inflect.numerals(1007) == "one thousand and seven"
    assert inflect.number("two thousand five hundred and eight") == 2508
    assert inflect.modality([("It", "PRP"), ("might", "MD"), ("rain", "VB")]) < 0 < inflect.modality([("It", "PRP"), ("will", "MD"), ("rain", "VB")])


def test_stemmer():
    words = {"consistency": "consist", "knightly": "knight", "national": "nation", "running": "run", "flies": "fli", "generously": "generous", "hopping": "hop", "hoping": "hope", "skis": "ski", "proceed": "proceed", "relational": "relat"}
    assert {w: stemmer.stem(w) for w in words} == words


def test_web(spark):
    df = spark.createDataFrame([("http://user:pass@www.x.com:80/a/b.html?q=1&w=a%20b#top",)], "u string").select(web.url_parts("u").alias("p")).first()["p"]
    assert (df["protocol"], df["username"], df["password"], df["domain"], df["port"], df["path"], df["page"], df["anchor"]) == ("http", "user", "pass", "www.x.com", 80, ["a"], "b.html", "top")
    assert [(x["k"], x["v"]) for x in df["query"]] == [("q", "1"), ("w", "a b")]
    assert web.typed_query("page=1&q=a&x=&f=1.5") == {"page": 1, "q": "a", "x": None, "f": 1.5}
    page = "<html><head><title>t</title></head><body id='front'><h1>Hi</h1><p class='note wide'>one <b>two</b></p><a href='/x' title='t'>link</a><p class='note'>three</p><script>x</script></body></html>"
    assert web.to_plaintext(page.replace("<head><title>t</title></head>", "")) == "Hi\n\none two\n\nlinkthree"
    nodes = web.Dom(page).nodes
    texts = lambda s: [n["text"] for n in web.Selector(s).search(nodes)]
    assert texts("p.note.wide") == ["one two"] and texts("p[class^='note']") == ["one two", "three"] and texts("p:contains('two')") == ["one two"]
    assert texts("body > p b") == ["two"] and texts("h1 + p") == ["one two"] and texts("h1, a") == ["Hi", "link"] and texts("#front a") == ["link"]
    assert web.strip_element("a<p>b<p>c</p></p>d", "p") == "ad"


def test_crawl(spark):
    pages = spark.createDataFrame([("http://a/1", "<a href='/2'>x</a><a href='http://b/1'>y</a>"), ("http://a/2", "<a href='/3'>z</a>")], "url string, html string")
    got = {(r["url"], r["step"], r["priority"]) for r in web.crawl(pages, pages.limit(1).select("url"), 3).collect()}
    assert got == {("http://a/1", 0, 1.0), ("http://a/2", 1, 0.8), ("http://b/1", 1, 0.75), ("http://a/3", 2, 0.8)}


def test_files(spark, tmp_path):
    assert files.decode_header("age (INTEGER)") == ("age", "INTEGER") and files.decode_header("name") == ("name", "STRING")
    df = spark.createDataFrame([("Lindqvist", "boat", True, 3, None), ('Hof"stadter', "labra,dor", False, None, 1.5)], "name string, type string, tail boolean, age long, w double")
    files.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "x.csv"), headers=True).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "x.xml").write_text(files.xml_document(df, "pets"))
    got = files.read_xml(spark, str(tmp_path / "x.xml"), "name string, type string, tail boolean, age bigint, w double")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))


def test_sheet(spark):
    s = files.Sheet.of(spark, [[1, 2, "a"], [1, 3, "b"], [1, 4, "c"], [0, 0, "d"]])
    assert [tuple(r) for r in s.group("c0").collect()] == [(1, 2, "a"), (0, 0, "d")]
    assert [tuple(r) for r in s.group("c0", ["count", "group_concat"]).collect()] == [(1, 3, "a,b,c"), (0, 1, "d")]
    grown = s.extend(files.Sheet.of(spark, [[7, 8, "e", 9]]))
    assert grown.df.count() == 5 and len(grown.columns) == 4
    assert [r["c1"] for r in s.insert_row(1, [5, 6, "z"]).remove_row(0).df.orderBy("_row").collect()] == [6, 3, 4, 0]


def test_rate_limit(spark):
    e = spark.createDataFrame([("u", i, float(t)) for i, t in enumerate((0, 1, 2, 3, 11, 12))], "user string, event_id long, at double")
    got = [(r["count"], r["accepted"]) for r in stateful.rate_limit_batch(e, 2, 10).orderBy("event_id").collect()]
    assert got == [(1, True), (2, True), (2, False), (2, False), (1, True), (2, True)]


def test_packets(spark):
    rows = spark.createDataFrame([(1, 0, "ab\nc"), (1, 1, "d\ne"), (1, 2, "\nrest")], "k int, o int, t string")
    assert [r["packet"] for r in stateful.packets(rows, "k", "t", "o").orderBy("n").collect()] == ["ab", "cd", "e"]
