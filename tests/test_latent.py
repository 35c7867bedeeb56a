import numpy as np
import pytest

from textloom.operators import latent
from textloom.operators.latent import LatentSemantics


@pytest.fixture(scope="module")
def matrix():
    dice = np.random.default_rng(3)
    return np.where(dice.random((40, 70)) < 0.25, dice.random((40, 70)), 0.0) + 0.6 * np.outer(dice.random(40), dice.random(70))


def frame(spark, m):
    return spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1]) if m[i, j]], "doc_id long, term string, w double")


def test_equals_numpy_over_all_terms(spark, matrix):
    u, s, vt = np.linalg.svd(matrix, full_matrices=False)
    m = LatentSemantics(k=4, extra=24, tolerance=1e-10).fit(frame(spark, matrix))
    assert m.converged and np.allclose(m.sigma, s[:4], rtol=0, atol=1e-6)
    concepts = {r.term: r.x for r in m.concepts.collect()}
    docs = {r.doc_id: r.x for r in m.documents.collect()}
    assert len(concepts) == 70 and len(docs) == 40
    v, d = np.array([concepts[f"t{j}"] for j in range(70)]), np.array([docs[i] for i in range(40)])
    assert np.allclose(d * m.sigma @ v.T, u[:, :4] * s[:4] @ vt[:4], atol=1e-4)
    again = {r.doc_id: r.x for r in m.transform(frame(spark, matrix)).collect()}
    assert np.allclose([again[i] for i in range(40)], d, atol=1e-4)


def test_low_rank_and_empty(spark):
    one = np.outer(np.arange(1, 6), np.arange(1, 8)).astype(float)
    m = LatentSemantics(k=3, extra=2).fit(frame(spark, one))
    assert len(m.sigma) == 1 and abs(m.sigma[0] - np.linalg.norm(one)) < 1e-6
    none = LatentSemantics(k=3).fit(frame(spark, one).limit(0))
    assert len(none.sigma) == 0 and none.documents.count() == none.concepts.count() == 0


def test_terms_of_one_document_are_one_column_and_come_apart_again(spark):
    w = np.array([[2.0, 1.0, 0.5, 3.0, 0, 0], [1.0, 0, 0, 0, 1.5, 0], [0, 1.0, 0, 0, 0, 4.0], [1.0, 1.0, 0, 0, 0, 0]])
    rows = spark.createDataFrame([(i, f"t{j}", float(w[i, j])) for i in range(4) for j in range(6) if w[i, j]], "doc_id long, term string, w double")
    single = latent._single(rows)
    assert sorted((r.term, r.of) for r in single.collect()) == [("t2", "d0"), ("t3", "d0"), ("t4", "d1"), ("t5", "d2")]
    assert latent._merged(rows, single).select("term").distinct().count() == 5
    m = latent.LatentSemantics(k=2, extra=2).fit(rows)
    u, s, vt = np.linalg.svd(w)
    assert np.allclose(m.sigma, s[:2])
    got = {r.term: np.abs(r.x) for r in m.concepts.collect()}
    assert sorted(got) == [f"t{j}" for j in range(6)] and all(np.allclose(got[f"t{j}"], np.abs(vt[:2, j]), atol=1e-6) for j in range(6))
