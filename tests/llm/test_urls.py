from textloom.llm import urls


def test_bad_dates_and_clashing_columns(spark):
    entries = spark.createDataFrame(
        [("a", "block", "domain", "x.org", "add", "2024-01-01"), ("a", "block", "domain", "x.org", "remove", "not a date"), ("b", "block", "host", "x.org", "add", "soon"), ("c", "allow", "host", "y.org", "add", None)],
        "list_id string, policy string, kind string, rule string, action string, dated string",
    )
    captures = spark.createDataFrame(
        [(1, "http://x.org/a", "2024-05-01", "mine"), (2, "http://x.org/a", "2023-05-01", "mine"), (3, "http://x.org/a", "never", "mine"), (4, "http://y.org/", None, "mine"), (5, None, "2024-05-01", "mine")],
        "page_id long, url string, fetched_at string, policy string",
    )
    rows = {r.page_id: r for r in urls.evaluate(captures, entries).collect()}
    assert {i: (r.n_active, r.blocked) for i, r in rows.items()} == {1: (1, True), 2: (0, False), 3: (0, False), 4: (0, False), 5: (0, False)}
    assert rows[1].matched == "block:a:domain:x.org" and rows[3].fetched_at is None
