"""Concept networks, stateful streams and mail on small inputs."""

import pytest

from textloom.operators import semantics
from textloom.sources import mail
from textloom.streaming import stateful


@pytest.fixture(scope="module")
def net(spark):
    rows = [("cat", "is-a", "animal"), ("dog", "is-a", "animal"), ("poodle", "is-a", "dog"), ("furry", "is-property-of", "cat"), ("furry", "is-property-of", "dog"), ("loud", "is-property-of", "dog"), ("car", "is-a", "thing")]
    return spark.createDataFrame([(*r, "", 0.5) for r in rows], "src string, relation string, dst string, context string, weight double")


def test_network(net):
    assert {r["descendant"]: r["distance"] for r in semantics.taxonomy(net, "animal").collect()} == {"cat": 1, "dog": 1, "poodle": 2}
    assert {r["property"] for r in semantics.properties(net, "dog").collect()} == {"furry", "loud"}
    assert "car" not in {r["src"] for r in semantics.halo(net, "cat").collect()}
    assert semantics.similarity(net, "cat", "dog", 2) > 0 == semantics.similarity(net, "cat", "car", 2)


def test_lin_similarity(spark):
    f = spark.createDataFrame([("root", 1), ("animal", 1), ("cat", 4), ("dog", 4), ("car", 10)], "id string, n long")
    h = spark.createDataFrame([("root", "animal"), ("animal", "cat"), ("animal", "dog"), ("root", "car")], "parent string, child string")
    s = {(r["a"], r["b"]): r["similarity"] for r in semantics.synset_similarity(f, h, spark.createDataFrame([("cat", "dog"), ("cat", "car")], "a string, b string")).collect()}
    assert s["cat", "dog"] > 0.4 and s["cat", "car"] == pytest.approx(0.0)


def test_rate_limit_stream(spark, tmp_path):
    e = spark.createDataFrame([("u", i, float(t)) for i, t in enumerate((0, 1, 2, 3, 11, 12))], "user string, event_id long, at double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.rate_limit_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 2, 10)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["accepted"] for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, False, False, True, True]


def test_mail(spark):
    raw = "From: a@b.c\nTo: d@e.f\nSubject: =?utf-8?q?h=C3=A9?=\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\nbody text\n"
    m = spark.createDataFrame([(raw,), (None,)], "raw string").select(mail.parse("raw").alias("m")).select("m.*")
    assert [(r["subject"], r["body"]) for r in mail.search(m, "A@B").collect()] == [("hé", "body text")]
