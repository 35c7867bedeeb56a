"""Vector space and graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import classify, graph, vector

BEES = [(0, "bees buzz"), (1, "bees hum"), (2, "owls hoot"), (3, "owls fly")]


@pytest.fixture(scope="module")
def p(spark):
    return vector.postings(spark.createDataFrame(BEES, "doc_id long, text string")).persist()


def test_weights(p):
    df = {r["term"]: (r["df"], round(r["idf"], 2)) for r in vector.document_frequency(p).collect()}
    assert df["bees"] == (0.5, 0.69) and df["buzz"] == (0.25, 1.39)
    w = {r["term"]: round(r["w"], 2) for r in vector.weights(p).where("doc_id = 0").collect()}
    assert w == {"bees": 0.35, "buzz": 0.69}


def test_similarity_and_search(p):
    v = vector.weights(p)
    sim = {(r["query_id"], r["doc_id"]): round(r["similarity"], 2) for r in vector.neighbors(v, v).collect()}
    assert sim[0, 1] == 0.20 and (0, 2) not in sim
    assert [(r["doc_id"], round(r["similarity"], 2)) for r in vector.search(p, ["hum"]).collect()] == [(1, 0.89)]
    pairs = p.sparkSession.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    assert {r["b"]: round(r["distance"], 1) for r in vector.distances(v, pairs).collect()} == {1: 0.8, 2: 1.0}


def test_distances(spark):
    v = spark.createDataFrame([(1, "bee", 1.0), (2, "bee", 0.5), (2, "owl", 1.0)], "doc_id long, term string, w double")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    got = {m: round(vector.distances(v, pairs, m).first()["distance"], 2) for m in (vector.COSINE, vector.EUCLIDEAN, vector.MANHATTAN, vector.HAMMING)}
    assert got == {"cosine": 0.55, "euclidean": 1.25, "manhattan": 1.5, "hamming": 1.0}


def test_frequent_sets_of_any_size(spark):
    sets = [(i, t) for i in range(4) for t in "abcde"] + [(4, "z")]
    got = {"".join(r["items"]) for r in vector.frequent_sets(spark.createDataFrame(sets, "doc_id long, term string"), 0.5).collect()}
    assert len(got) == 31 and "abcde" in got
    assert max(map(len, [r["items"] for r in vector.frequent_sets(spark.createDataFrame(sets, "doc_id long, term string"), 0.5, 2).collect()])) == 2


def test_frequent_sets(spark):
    sets = [(i, t) for i, s in enumerate([[1, 2, 4], [1, 2, 5], [1, 3, 6], [1, 3, 7]]) for t in s]
    got = {tuple(r["items"]): r["support"] for r in vector.frequent_sets(spark.createDataFrame(sets, "doc_id long, term int"), 0.5).collect()}
    assert got == {(1,): 1.0, (2,): 0.5, (3,): 0.5, (1, 2): 0.5, (1, 3): 0.5}


def test_cooccurrence(spark):
    docs = spark.createDataFrame([("The brown hen ran to the barn.",)], "text string")
    got = vector.cooccurrence(docs, vector.words(F.lower("text")), (-1, 1), term1=F.col("term1") == "hen").collect()
    assert {r["term2"]: r["n"] for r in got} == {"brown": 1, "hen": 1, "ran": 1}


def test_classifiers(p, spark):
    labels = spark.createDataFrame([(0, "bee"), (1, "bee"), (2, "owl"), (3, "owl")], "doc_id long, label string")
    new = vector.postings(spark.createDataFrame([(9, "owls owls buzz"), (8, "bees hum")], "doc_id long, text string"))
    for model in (classify.NaiveBayes(), classify.NaiveBayes(classify.BERNOULLI), classify.NearestNeighbors(2), classify.Perceptron()):
        got = {r["doc_id"]: r["predicted"] for r in model.train(vector.weights(p, vector.TF), labels).predict(vector.weights(new, vector.TF)).collect()}
        assert got[8] == "bee", type(model)


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdex"], "id string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.0), ("b", "d", 0.0), ("d", "e", 0.0)], "src string, dst string, weight double")
    return nodes, edges


def test_adjacency_and_paths(g):
    nodes, edges = g
    adj = {(r["a"], r["b"]): r["cost"] for r in graph.adjacency(edges).collect()}
    assert adj["a", "b"] == 0.75 and adj["c", "a"] == 1.0 and len(adj) == 8
    st = {(r["a"], r["b"]): round(r["cost"], 2) for r in graph.adjacency(edges, directed=True, stochastic=True).collect()}
    assert st["a", "b"] == 0.43 and st["a", "c"] == 0.57
    more = graph.add_edges(edges, nodes.sparkSession.createDataFrame([("a", "d", 0.0)], "src string, dst string, weight double"))
    found = sorted((r["path"] for r in graph.paths(more, "a", "d", 3).collect()), key=len)
    assert found == [["a", "d"], ["a", "b", "d"]]
    short = {r["id"]: r["path"] for r in graph.shortest_paths(edges, nodes.where("id = 'a'")).collect()}
    assert short["e"] == ["a", "b", "d", "e"] and "x" not in short


def test_components_cliques_and_fringe(g, spark):
    nodes, edges = g
    comp = {r["id"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "a", "x": "x"}
    more = edges.unionAll(spark.createDataFrame([("b", "c", 0.0)], "src string, dst string, weight double"))
    assert sorted("".join(r["nodes"]) for r in graph.cliques(more, 2).collect()) == ["abc", "bd", "de"]
    path = spark.createDataFrame([("a", "b", 0.0), ("b", "c", 0.0)], "src string, dst string, weight double")
    abc = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(r["id"] for r in graph.fringe(abc, path).collect()) == ["a", "c"]
    top = graph.betweenness(abc, path, groups=2).orderBy(F.desc("betweenness")).first()
    assert (top["id"], top["betweenness"]) == ("b", 1.0)
    assert graph.eigenvector(abc, path).orderBy(F.desc("eigenvector")).first()["id"] == "c"


def test_graphs_larger_than_a_bound(spark):
    complete = spark.createDataFrame([(a, b, 0.0) for a in range(9) for b in range(a)], "src long, dst long, weight double")
    assert [sorted(r["nodes"]) for r in graph.cliques(complete).collect()] == [list(range(9))]
    with pytest.raises(RuntimeError):
        graph.cliques(complete, most=8)
    chain = spark.createDataFrame([(i, i + 1) for i in range(23)], "parent long, child long")
    far = {(r["ancestor"], r["descendant"]): r["distance"] for r in graph.closure(chain).collect()}
    assert far == {(a, b): b - a for a in range(24) for b in range(a + 1, 24)}
    assert graph.closure(chain, 2).count() == 23 + 22
    way = chain.where("child < 4").selectExpr("parent AS src", "child AS dst", "0.0D AS weight")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(way, spark.range(1), most=2)


def test_queries_take_whole_tables(spark, tmp_path):
    from textloom.plans import q_text, q_vector

    kinds = {i: i // 2 % 2 for i in range(12)}
    texts = [(i, f"{'bees buzz' if q else 'owls fly'} w{i}") for i, q in kinds.items()]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in kinds.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # by brute force: all training documents that share a word with a held-out one are of its own kind
    assert {r["doc_id"]: r["predicted"] for r in q_vector.knn(spark, str(tmp_path)).collect()} == {i: f"q{q}" for i, q in kinds.items() if i % 2}
    spark.createDataFrame([(30, "http://a.com/1", "<p>x</p>"), (31, "http://b.com/1", "<p>y</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert q_text.crawl(spark, str(tmp_path)).count() == 2
