import duckdb

from textloom.operators import web
from textloom.plans import catalog
from textloom.sources import pages

ODD = ["x<h1>a &am</h1><h2 class=b>q &ampx &lt;b&gt; &notit; &#65;&#x41 &#128; &#0; &zzz; & b&</h2>", "<H3>A\n b \t\tc</h3 ><h1>open<h2>x &quot &a</h2>", "<h1>AT&T, R&D; &copy 2 &amp;lt;</h1>", "none", None]


def test_an_ampersand_that_begins_no_reference_stays():
    assert web.to_plaintext("The&a") == "The&a"
    assert web.to_plaintext("a &foo b&amp") == "a &foo b&"
    assert web.strip_tags('<a href="?x&amp;y">a &lt b</a><i>&#65</i>', keep=["a"]) == '<a href="?x&amp;y">a &lt b</a>&#65'


def test_the_sql_of_sections_decodes_as_the_query():
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(ODD)))
    rows = db.execute(catalog.oracle_sql()["web_sections"]).fetchall()
    parts = [pages._HEADING.split(x or "") for x in ODD]
    assert sorted(rows) == sorted((i, int(p[k]), web.to_plaintext(p[k + 1])) for i, p in enumerate(parts) for k in range(1, len(p), 3))
    assert len(rows) == 5
