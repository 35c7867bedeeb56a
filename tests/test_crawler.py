import pytest
from pyspark.sql import functions as F

from textloom.operators import crawler


@pytest.fixture()
def web(spark):
    pages = [(f"http://a.com/{i}", "") for i in range(8)] + [("http://b.com/x", ""), ("http://c.com/only", "")]
    links = [("http://a.com/0", f"http://a.com/{i}") for i in range(1, 8)] + [("http://a.com/3", "http://B.com/x#part"), ("http://b.com/x", "http://a.com/0/"), ("http://b.com/x", "http://gone.com/404"), ("http://b.com/x", "http://b.com/x")]
    return spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(links, "page string, url string")


def test_everything_reachable_is_visited_politely(spark, web, tmp_path):
    c = crawler.Crawl(spark, str(tmp_path / "c"), *web, delay=10.0, pace=20.0)
    c.push(spark.createDataFrame([("http://a.com/0",)], "url string"))
    rows = c.run().collect()
    assert sorted(r.url for r in rows) == sorted([f"http://a.com/{i}" for i in range(8)] + ["http://b.com/x", "http://gone.com/404"])
    assert {r.url for r in rows if not r.found} == {"http://gone.com/404"}
    times = sorted(r.fetched_at for r in rows if r.host == "a.com")
    assert all(b - a >= 10 for a, b in zip(times, times[1:], strict=False)) and len({r.step for r in rows}) >= 4
    assert {r.url: r.depth for r in rows}["http://b.com/x"] == 2
    assert c.done() and c.step() == 0
    # new seeds are taken up
    c.push(spark.createDataFrame([("http://c.com/only",), ("http://a.com/1",), (None,)], "url string"))
    assert c.run().count() == len(rows) + 1


def test_a_crawl_is_resumed(spark, web, tmp_path):
    at = str(tmp_path / "c")
    c = crawler.Crawl(spark, at, *web, delay=10.0, pace=20.0)
    c.push(spark.createDataFrame([("http://a.com/0",)], "url string"))
    assert c.run(2).count() == 3
    assert not c.done()
    again = crawler.Crawl(spark, at, *web, delay=10.0, pace=20.0)
    # a round that was cut off between its two tables goes on with what it had fetched
    again._publish(again._chosen(again._next()).withColumn("found", F.lit(True)), "visited", again._next())
    rows = again.run().collect()
    assert len(rows) == 10 == len({r.url for r in rows})
    whole = crawler.Crawl(spark, str(tmp_path / "d"), *web, delay=10.0, pace=20.0)
    whole.push(spark.createDataFrame([("http://a.com/0",)], "url string"))
    assert sorted((r.url, r.step) for r in whole.run().collect()) == sorted((r.url, r.step) for r in rows)


def test_follow_and_priority_are_expressions(spark, web, tmp_path):
    c = crawler.Crawl(spark, str(tmp_path / "c"), *web, follow=F.col("host") == F.col("page_host"), priority=F.regexp_extract("url", r"/(\d+)$", 1).cast("double"), delay=1.0, pace=1.0)
    c.push(spark.createDataFrame([("http://a.com/0",)], "url string"))
    rows = c.run().orderBy("step").collect()
    assert [r.url[-1] for r in rows] == list("07654321")
    external = crawler.default_priority(crawler.BREADTH)
    d = crawler.Crawl(spark, str(tmp_path / "d"), *web, priority=external)
    assert d.frontier().isEmpty() and d.run().count() == 0
    with pytest.raises(ValueError, match="depth or breadth"):
        crawler.default_priority("other")
