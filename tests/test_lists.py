"""Lists, codes, secrets, models, trees and transactions with known answers."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import lists, secrets
from textloom.operators import classify, models, query, trees, vector


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_arrays(spark):
    a = F.array(*map(F.lit, ("d", "b", "a", "b")))
    assert one(spark, lists.order(a)) == [2, 1, 3, 0] and one(spark, lists.order(a, reverse=True)) == [0, 1, 3, 2]
    assert one(spark, lists.unique(a)) == ["d", "b", "a"]
    assert one(spark, lists.product(F.array(F.lit("x"), F.lit("y")), 3))[:3] == [["x", "x", "x"], ["x", "x", "y"], ["x", "y", "x"]]
    assert one(spark, lists.combinations(F.array(F.lit("c"), F.lit("a")), 2)) == [["c", "c"], ["c", "a"], ["a", "c"], ["a", "a"]]
    assert one(spark, lists.combinations(F.array(F.lit("c"), F.lit("a")), 0)) == [[]]
    assert one(spark, lists.variations(F.array(F.lit("p?"), F.lit("q"), F.lit("r?")), lambda x: x.endswith("?"))) == [["p?", "q", "r?"], ["q", "r?"], ["p?", "q"], ["q"]]
    assert one(spark, lists.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]
    p = one(spark, lists.moved(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(90.0)))
    assert (round(p["x"], 9), round(p["y"], 9)) == (1.0, 3.0)


def test_chunks_and_ordinals(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7)], "k long")
    assert [r["chunk"] for r in lists.chunks(df, 2, "k").orderBy("k").collect()] == [0, 0, 0, 1, 1]
    assert [r["chunk"] for r in lists.chunks(df, 8, "k").orderBy("k").collect()] == [0, 1, 2, 3, 4]
    assert lists.ordinals(df.limit(0), "k").collect() == []
    assert lists.first_match(df, F.col("k") > 3, "k").first()["k"] == 5 and lists.first_match(df, F.col("k") > 99, "k").first() is None


def test_suffixes(spark):
    pairs = spark.createDataFrame([("eau", "eaux"), ("feu", "feux"), ("vert", "verte"), ("go", "went")], "b string, i string")
    got = {(r["suffix"], r["base_suffix"]): (r["count"], r["share"]) for r in lists.suffixes(pairs, "b", "i").collect()}
    assert got == {("aux", "au"): (1, 1.0), ("eux", "eu"): (1, 1.0), ("rte", "rt"): (1, 1.0)}


def test_secrets(spark):
    import hashlib

    assert one(spark, secrets.pbkdf2(F.lit("pw"), F.lit("salt"), 10)) == hashlib.pbkdf2_hmac("sha256", b"pw", b"salt", 10, 32).hex()
    kept = secrets.encode_password("pässword", 10)
    assert secrets.verify_password("pässword", kept) and not secrets.verify_password("password", kept)
    df = spark.createDataFrame([("Ada", 3.0, None)], "name string, n double, z string")
    assert df.select(secrets.template("$name: ${n * 2}$$[$z]").alias("x")).first()["x"] == "Ada: 6.0$[]"
    assert one(spark, secrets.language_name(F.lit("DE"))) == "German" and one(spark, secrets.region_code(F.lit("france"))) == "FR" and one(spark, secrets.region_name(F.lit("xx"))) is None
    assert one(spark, secrets.regions_of(F.lit("fr"))) == ["CA", "FR"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(0, "red red apple"), (1, "red cherry"), (2, "blue sea"), (3, "blue sky sky")]
    p = vector.postings(spark.createDataFrame(texts, "doc_id long, text string")).persist()
    return p, spark.createDataFrame([(0, "fruit"), (1, "fruit"), (2, "view"), (3, "view")], "doc_id long, label string")


def test_models(corpus, spark, tmp_path):
    p, labels = corpus
    v = vector.weights(p, vector.TF)
    b = models.baselines(labels.unionAll(spark.createDataFrame([(9, "view")], "doc_id long, label string"))).first()
    assert (b["majority"], b["minority"], b["baseline"], round(b["weighted_random_baseline"], 2), round(b["skewness"], 3)) == ("view", "fruit", 0.6, 0.52, -0.408)
    model = classify.NaiveBayes(alpha=0.01).train(v, labels)
    models.save(model, str(tmp_path / "nb"))
    again = models.load(spark, str(tmp_path / "nb"), classify.NaiveBayes)
    assert again.alpha == 0.01 and sorted(map(str, again.classify(v).collect())) == sorted(map(str, model.classify(v).collect()))
    found = models.grid_search(classify.NaiveBayes, v, labels, 2, alpha=[0.01, 0.1])
    assert len(found) == 2 and found[0][0]["accuracy"] >= found[1][0]["accuracy"]
    seeds = models.plus_plus(v, 2, seed=3).collect()
    assert len({r["doc_id"] for r in seeds}) == 2 and len(models.plus_plus(v, 9).collect()) <= 4
    d = models.Distances(v)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    first = {(r["a"], r["b"]): round(r["distance"], 6) for r in d.of(pairs).collect()}
    assert first[0, 2] == 1.0 and {(r["a"], r["b"]): round(r["distance"], 6) for r in d.of(pairs).collect()} == first
    c = models.Corpus(p).append(vector.postings(spark.createDataFrame([(1, "new"), (7, "x")], "doc_id long, text string"))).remove(spark.range(1).select(F.col("id").alias("doc_id")))
    assert sorted({r["doc_id"] for r in c.postings.collect()}) == [1, 2, 3, 7] and [r["term"] for r in c.document(1).collect()] == ["new"]
    head, lines = models.arff(v, labels, "r")
    assert head.endswith("@ATTRIBUTE class {fruit,view}\n@DATA") and lines.where("doc_id = 1").first()["line"] == "0.0000,0.0000,0.5000,0.5000,0.0000,0.0000,fruit".replace("0.0000", "0")
    assert models.orange_tab(v, labels)[0].split("\t")[-2:] == ["m#name", "c#type"]


def test_trees(spark):
    w = lambda word, tag, chunk, pnp="O": {"word": word, "tag": tag, "chunk": chunk, "pnp": pnp}
    s = [w("a", "DT", "B-NP"), w("ship", "NN", "I-NP"), w("sank", "VBD", "B-VP"), w('"<', ".", "O")]
    assert trees.brackets(s) == '(S (NP (DT a) (NN ship)) (VP (VBD sank)) (. "<))'
    assert trees.from_xml(trees.to_xml([s, s[:1]])) == [s, s[:1]]
    assert trees.table(s).split("\n")[1].split() == ["a", "DT", "B-NP", "-"] and "w1" in trees.dot(s)
    kind = "array<array<struct<word:string,tag:string,chunk:string,pnp:string>>>"
    df = spark.createDataFrame([([s],), (None,)], f"parsed {kind}")
    got = df.select(trees.rendering(trees.brackets)("parsed").alias("b"), trees.parsed_xml(trees.rendering(trees.to_xml, each=False)("parsed")).alias("p")).collect()
    assert got[0]["b"].startswith("(S (NP") and [r.asDict() for r in got[0]["p"][0]] == s and got[1]["b"] is None


def test_commit_and_rollback(spark, tmp_path):
    d = query.Database(spark)
    t = d.create("t", spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string"), key="id")
    d.commit(str(tmp_path / "db"))
    t.update(1, name="z")
    assert sorted(t.rows()) == [(1, "z"), (2, "y")]
    d.rollback(str(tmp_path / "db"))
    assert sorted(t.rows()) == [(1, "x"), (2, "y")]
    with pytest.raises(KeyError):
        with d.transaction():
            t.delete(1)
            raise KeyError("no")
    assert t.count() == 2


def test_tag_model(spark):
    from textloom.operators.tagmodel import TagModel

    say = lambda a, n, v: [(a, "DT"), (n, "NN"), (v, "VBZ")]
    sentences = [say(a, n, v) for a in ("the", "a") for n in ("ship", "crew", "storm") for v in ("waits", "sails", "turns")]
    df = spark.createDataFrame([(s,) for s in sentences], "words array<struct<word:string,tag:string>>")
    model = TagModel().train(df)
    assert model.tag(["the", "boat", "drifts"]) == [("the", "DT"), ("boat", "NN"), ("drifts", "VBZ")]
    got = spark.createDataFrame([(["a", "ship", "sails"],), ([],), (None,)], "w array<string>").select(model.udf()("w").alias("t")).collect()
    assert [x["tag"] for x in got[0]["t"]] == ["DT", "NN", "VBZ"] and got[1]["t"] == [] and got[2]["t"] is None
    assert TagModel().train(df.limit(0)).tag(["x"]) == [("x", "")]
