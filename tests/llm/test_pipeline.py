import corpus_pipeline
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_all_that_was_kept(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        before, after = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before
        if k < 4:
            assert out.columns == columns
        if k == 1:
            assert after == {c for d, _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
        if k >= 3:
            assert after == before
        if k == 3:
            assert out.where(F.col("text").rlike("@mail")).count() == 0
        if k == 4:
            assert out.where("not round_trip or n_pieces <> size(ids)").count() == 0
        docs = out


def test_odd_rows_pass(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a@b.cc " * 9, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF).cache()
        docs.count()  # as when written: a stage deletes what the ones before it left in the shared folder
    assert sorted((r["doc_id"] or -1) for r in docs.collect()) == [-1, 1, 2]
