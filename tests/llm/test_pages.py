import re
from html import unescape

from textloom.llm import pages


def article(html):
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.S)
    blocks = re.split(r"</?(?:p|h1|article)>", m[1])
    return "\n\n".join(x for x in (" ".join(unescape(re.sub(r"<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks) if x)


def site(i, host="a.example.com"):
    return (
        i, f"https://{host}/{i}",
        f"<!DOCTYPE html><html><head><title>t {i}</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><!-- ad {i} --><div class=\"ad\">Buy</div>"
        f"<div><p>Same words on all pages of the host</p></div><article><h1>Title {i} &amp; more&copy</h1><p><b>First {i}\n  text.<br><p>a &lt; b &#233;{i}</p><p>5 < 6 {i}<div class=x>inner {i}</div></article>"
        f"<div class='comments'><p>nice {i}</p></div><form><input><p>sign {i}</form><aside>side {i}</aside><footer>&copy; me {i}</footer>",
    )


def test_extracts_the_article_of_a_site(spark):
    rows = [(*site(i), 3) for i in range(12)]
    got = {r["page_id"]: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, drop int")).collect()}
    for i in range(12):
        assert got[i]["text"] == f"Title {i} & more©\n\nFirst {i} text.\n\na < b é{i}\n\n5 < 6 {i}\n\ninner {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (2, "nonsense", ""), (3, "http://b/", "<p>" * 3000 + "deep"), (4, "http://b/", "<div>" * 3000 + "deep &am & x<"), (5, "http://b/", "a<b 'q <i x=\"unclosed>t</i>"), (None, "http://b/", "<!-- open")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 7 and text[1] == "" and text[2] == "" and text[3] == "deep" and text[4] == "deep &am & x<" and text[None] == ""
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_host_of_two_pages_and_copies_of_one(spark):
    html = lambda i: f"<body><div class='x'><p>On all pages</p></div><div class='y'><h1>Title {i}</h1><p>One {i}</p><p>Two {i}</p></div></body>"
    rows = [(1, "http://two/1", html(1)), (2, "http://two/2", html(2)), (3, "http://one/3", html(3)), (4, "http://copy/4", html(4)), (4, "http://copy/4", html(4))]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("" if i < 3 else "On all pages\n\n") + f"Title {i}\n\nOne {i}\n\nTwo {i}" for i in range(1, 5)}


def test_matches_a_plain_extraction_of_the_tables_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in df.collect()}
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert got == {i: article(h) for i, h in html.items()}


def test_many_captures_of_one_page_give_its_article(spark):
    html = lambda i: f"<body><div class='m'><p>Menu</p></div><div class='t'><h1>Title {i}</h1><p>One {i}</p><p>Two {i}</p></div></body>"
    for n in (5, 10, 200):
        rows = [(k, "http://h/1", html(1)) for k in range(n)] + [(1000 + k, f"http://h/{k}", html(k)) for k in range(2, 5)]
        got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(got[k] == "Title 1\n\nOne 1\n\nTwo 1" for k in range(n)) and got[1003] == "Title 3\n\nOne 3\n\nTwo 3"


def test_names_and_references(spark):
    text = lambda h: pages_of(spark, h)
    assert text("<article><header><h1>T</h1></header><p class='post-header'>a</p><p class='legal'>b</p><p class='share-price'>c</p></article>") == "T\n\na\n\nb\n\nc"
    assert text("<header>x</header><div class='userComments'><p>y</p></div><div id='ad-slot-3'>z</div><article>a<div class='article-comments'>c</div><div class='related-posts'>r</div></article>") == "a"
    assert text("<p>&<b>lt;</b> &am<i>p;</i> &lt;</p>") == "&lt; &amp; <"


def pages_of(spark, html):
    return pages.extract(spark.createDataFrame([(1, "http://h/1", html)], "page_id long, url string, html string")).first()["text"]


def test_a_megabyte_of_nested_elements(spark):
    deep = "<div>a" * 170_000
    assert pages_of(spark, deep) == "\n\n".join("a" * 170_000)
    assert pages_of(spark, "<script>" * 50_000 + "x") == ""


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://h/1", "<p>x</p>", 1, 2, 3, 4)], "page_id long, url string, html string, host int, salt int, h int, drop int")
    assert pages.extract(df).first()["text"] == "x"
