import random

from pyspark.sql import functions as F

from textloom.operators import vector
from textloom.plans import catalog


def test_blocks_give_all_pairs_with_their_weights(spark, monkeypatch):
    monkeypatch.setattr(vector, "OVERLAP_DOCS", 9)
    monkeypatch.setattr(vector, "OVERLAP_ENTRIES", 50)
    r = random.Random(5)
    texts = {f"d{i}": [r.choice("abcd") for _ in range(r.randrange(14))] for i in range(60)}
    texts |= {f"own{i}": [f"own{i}"] * 4 + list("a license line for all of us") for i in range(20)} | {f"copy{i}": list(texts["d5"]) for i in range(9)} | {"alone": ["alone"] * 5, "empty": [], None: list("abcdabcd")}
    docs = spark.createDataFrame([(i, [" ".join(t[k : k + 3]) for k in range(len(t) - 2)]) for i, t in texts.items()] + [("d1", ["a a a", "one more"]), ("null", None)], "doc_id string, grams array<string>")
    docs = docs.withColumn("n_grams", F.coalesce(F.size("grams"), F.lit(0)))
    want = sorted(map(tuple, vector.intertextuality(docs.select("doc_id", F.explode("grams").alias("gram"))).collect()))
    for met in (1, 1 << 18):
        monkeypatch.setattr(vector, "MET", met)
        assert sorted(map(tuple, vector.overlaps(docs).collect())) == want and len(want) > 1000
    assert vector.overlaps(docs.limit(0)).collect() == []


def test_the_query_gives_each_pair(spark, tmp_path):
    rows = [(0, "one two three four five six"), (1, "two three four five six seven eight"), (2, "ONE two three four\nfive"), (3, "else"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["vector_intertextuality"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0.5), (0, 2, 0.5), (1, 0, 1 / 3), (2, 0, 1.0)]


def test_a_stripe_of_queries_is_met_by_columns_and_postings(spark, monkeypatch):
    # the products are the same whichever terms are columns, and memory is that of a stripe
    r = random.Random(11)
    docs = {i: {f"t{int(r.random() ** 3 * 60)}": r.random() + 0.01 for _ in range(r.randrange(1, 12))} for i in range(70)} | {i: {"t1": 0.5, "t2": 0.25} for i in range(70, 80)}
    v = spark.createDataFrame([(i, t, w) for i, d in docs.items() for t, w in d.items()] + [(90, "t3", 0.0), (91, "t3", float("nan"))], "doc_id long, term string, w double")
    found = []
    for stripe, dense, products in ((3, 1 << 11, 1 << 16), (128, 0, 7), (1, 2, 1)):
        for name, value in (("BLOCK_DOCS", 20), ("STRIPE", stripe), ("DENSE", dense), ("PRODUCTS", products)):
            monkeypatch.setattr(vector, name, value)
        found.append(sorted((x.query_id, x.rank, x.doc_id, round(x.similarity, 12)) for x in vector.neighbors(v, v.where("doc_id % 2 = 1"), 4).collect()))
    assert found[0] == found[1] == found[2] and len({q for q, *_ in found[0]}) == 40
    signed = v.withColumn("w", F.when(F.col("term") == "t0", -F.col("w")).otherwise(F.col("w"))).where("doc_id < 90")
    d = {i: {t: -w if t == "t0" else w for t, w in x.items()} for i, x in docs.items()}
    norm = {i: sum(w * w for w in x.values()) ** 0.5 for i, x in d.items()}
    cos = lambda a, b: sum(w * d[b].get(t, 0.0) for t, w in d[a].items()) / norm[a] / norm[b]
    got = {(x.query_id, x.rank): round(x.similarity, 9) for x in vector.neighbors(signed, signed.where("doc_id % 2 = 1"), 4).collect()}
    assert got == {(q, k): round(s, 9) for q in d if q % 2 for k, s in enumerate(sorted((cos(q, x) for x in d if x != q and cos(q, x) > 1e-12), reverse=True)[:4], 1)}
