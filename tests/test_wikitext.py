import time

from textloom.sources import wikitext


def plain(text: str) -> str:
    return "\n".join(s["text"] for s in wikitext.parse(text))


def test_marks_are_taken_off():
    assert plain("A '''bold''' and ''fine'' [[word|label]] of [[kind]]s.") == "A bold and fine label of kinds."
    assert plain("x{{box|a={{b|[[c]]}}|d}}y{| class=t\n|-\n| cell || {{z}}\n|}z<ref name=a>note [[n]]</ref><ref name=a/>w<!-- no [[way -->!") == "xyzw!"
    assert plain("[[File:a.png|thumb|A [[cat]] sits]]Text [[Category:Cats]]here [http://x.org a link]") == "Text here a link"
    assert plain("<nowiki>[[raw]] ''as is'' {{x}}</nowiki>") == "[[raw]] ''as is'' {{x}}"
    assert plain("* one\n# two\n:: three") == "one\ntwo\nthree"


def test_what_is_never_closed_stays():
    assert plain("a {{b [[c|d") == "a {{b [[c|d"
    assert plain("a ]] b }} c |} d | e") == "a ]] b }} c |} d | e"
    assert plain("{{a [[b}} c") == "c"
    assert plain("x <ref>open") == "x <ref>open"
    assert plain("") == "" and plain("=") == "="


def test_sections_are_a_tree():
    got = wikitext.parse("lead\n== A ==\none\n=== A.1 ===\ntwo\n==== deep '''x''' ====\n=== A.2 ===\n== B [[c|d]] ==\nlast\n{{box\n== not ==\n}}end")
    assert [(s["number"], s["parent"], s["level"], s["title"], s["text"]) for s in got] == [
        (0, -1, 0, "", "lead"), (1, -1, 2, "A", "one"), (2, 1, 3, "A.1", "two"), (3, 2, 4, "deep x", ""), (4, 1, 3, "A.2", ""), (5, -1, 2, "B d", "last\nend"),
    ]
    assert wikitext.parse("== First ==\nx")[1]["title"] == "First"


def test_deep_and_long_texts_take_linear_time():
    n = 40_000
    start = time.time()
    assert plain("{{" * n + "}}" * n + "end") == "end"
    assert plain("[[a|" * n + "b" + "]]" * n) == "b"
    assert plain("word " * 200_000).count("word") == 200_000
    assert len(plain("{{" * n)) == 2 * n
    assert time.time() - start < 20


def test_column(spark):
    rows = spark.createDataFrame([(1, "a\n== b ==\nc"), (2, None)], "id long, t string").select("id", wikitext.sections("t").alias("s")).collect()
    assert {r.id: [(s.title, s.text) for s in r.s] for r in rows} == {1: [("", "a"), ("b", "c")], 2: [("", "")]}
