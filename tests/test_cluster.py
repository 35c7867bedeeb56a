"""Clusters, trees and latent semantics on a small corpus with two topics."""

import pytest

from textloom.operators import cluster, vector

DOCS = [(0, "cat cat whiskers purr"), (1, "cat purr purr claws"), (2, "dog bark bark tail"), (3, "dog tail bark bone")]


@pytest.fixture(scope="module")
def p(spark):
    return vector.postings(spark.createDataFrame(DOCS, "doc_id long, text string")).persist()


def test_k_means_and_hierarchy(p):
    v = vector.weights(p, vector.TF)
    for seed in range(9):
        at = {r["doc_id"]: r["cluster"] for r in cluster.k_means(v, 2, seed=seed).collect()}
        if at[0] != at[2]:
            break
    assert at[0] == at[1] and at[2] == at[3]
    steps = cluster.hierarchical(v, 2)
    assert sorted(sorted(a + b) for _, a, b, _ in steps) == [[0, 1], [2, 3]]


def test_tree_and_prototypes(p, spark):
    labels = spark.createDataFrame([(0, "cat"), (1, "cat"), (2, "dog"), (3, "dog")], "doc_id long, label string")
    got = {r["doc_id"]: r["predicted"] for r in cluster.GainTree().train(p, labels).predict(p).collect()}
    assert got == {0: "cat", 1: "cat", 2: "dog", 3: "dog"}
    assert {r["label"] for r in cluster.condensed(vector.weights(p, vector.TF), labels, rounds=1).collect()} == {"cat", "dog"}


def test_latent_semantics(p):
    docs, terms = cluster.latent_semantics(vector.weights(p, vector.TF), 2)
    w = {(r["doc_id"], r["concept"]): r["w"] for r in docs.collect()}
    main = {d: max((0, 1), key=lambda c: w[d, c]) for d in range(4)}
    assert main[0] == main[1] != main[2] == main[3] and terms.count() == 2 * p.select("term").distinct().count()


def test_genetic():
    class Max(cluster.Genetic):
        def fitness(self, c):
            return c

        def combine(self, a, b):
            return (a + b) // 2 + 1

    g = Max(range(10))
    before = g.fittest
    g.update()
    assert g.generation == 1 and len(g.population) == 10 and g.fittest >= before
