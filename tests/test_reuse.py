import random

from pyspark.sql import functions as F

from textloom.operators import vector
from textloom.plans import catalog


def _grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]


def test_links_and_classes_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK_CLASSES", 7)
    monkeypatch.setattr(vector, "BLOCK_ENTRIES", 40)
    r = random.Random(7)
    texts = {i: [r.choice("abcd") for _ in range(r.randrange(12))] for i in range(60)}
    texts |= {60 + i: [f"own{i}"] * 4 + list("a license line for all of us") for i in range(30)} | {90 + i: list(texts[5]) for i in range(9)} | {99: ["alone"] * 5, 100: []}
    docs = spark.createDataFrame([(i, _grams(t)) for i, t in texts.items()], "doc_id long, grams array<string>")
    pairs = vector.intertextuality(docs.select("doc_id", F.explode("grams").alias("gram"))).collect()
    several = {g for g in {g for t in texts.values() for g in _grams(t)} if sum(g in _grams(t) for t in texts.values()) > 1}
    shared = {i: frozenset(_grams(t)) & several for i, t in texts.items()}
    classes = {i: min(j for j in texts if shared[j] == shared[i]) if shared[i] else i for i in texts}
    got = {x.doc_id: x for x in vector.reuse(docs).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        mine = [(-x.weight, classes[x.b]) for x in pairs if x.a == i]
        weight, closest = min(mine, default=(0.0, None))
        assert (got[i].class_id, got[i].n_grams, got[i].n_links, got[i].closest, got[i].weight) == (classes[i], len(_grams(t)), len(mine), closest, -weight)
        assert abs(got[i].weights + sum(w for w, _ in mine)) < 1e-9


def test_rows_of_one_id_are_one_document_and_nulls_have_no_links(spark):
    docs = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x", "z"]), ("b", ["x", "z"]), ("c", None), ("d", ["q", "q"])], "doc_id string, grams array<string>")
    got = {x.doc_id: tuple(x)[1:] for x in vector.reuse(docs).collect()}
    assert got == {"a": ("a", 4, 1, "a", 0.5, 0.5), "b": ("a", 2, 1, "a", 1.0, 1.0), "c": ("c", 0, 0, None, 0.0, 0.0), "d": ("d", 2, 0, None, 0.0, 0.0)}
    assert vector.reuse(docs.limit(0)).collect() == []


def test_a_common_line_gives_a_row_for_each_document_not_for_each_pair(spark, tmp_path):
    rows = [(i, f"number {i} has this line that all of them have") for i in range(80)] + [(80, None), (81, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["vector_text_reuse"](spark, str(tmp_path)).collect()
    assert len(got) == 82
    assert {(x.class_id, x.n_links, x.closest, x.weight) for x in got if x.doc_id < 80} == {(0, 79, 0, 4 / 6)}
