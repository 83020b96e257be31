import corpus_pipeline as cp
from cohortry.llm import decontaminate


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2]  # few labels at the smallest size
    assert counts[2] > counts[3] > counts[4] > 0
    assert decontaminate.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count() == 0
    last = cp.STAGES[-1][1](spark, docs, sf)
    assert last.count() == counts[4]


def test_stages_on_odd_rows(spark, sf, docs, no_docs):
    for rows in (docs, no_docs):
        for _, stage in cp.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == docs.columns
            rows = cp.materialise(rows, "odd")


def test_run(spark, sf):
    assert cp.run(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
