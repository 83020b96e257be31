from pyspark.sql import functions as F, types as T

from cohortry.functions import textids as X
from cohortry.sources import readers as R
from cohortry.streaming.ingest import read_table, start_ingest


def test_jsonl_last_line_wins_and_torn_lines_are_skipped(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n{"k": 1, "v"\n{"k": 1, "v": "c"}\n')
    s = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    assert {(r["k"], r["v"]) for r in R.jsonl_last_wins(spark, str(tmp_path), s, "k").collect()} == {(1, "c"), (2, "b")}


def test_dump_is_addressed_by_header(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes(b'b,a,c\n1,"x, y",q\nbad,z\xff,q\n')
    got = R.delimited_dump(spark, str(tmp_path / "*.csv"), {"a": "string", "b": "int"}).collect()
    assert [(r["a"][0], r["b"]) for r in got] == [("x", 1), ("z", None)]


def test_later_shard_overrides_and_repair_replaces(spark):
    s = spark.createDataFrame([("a", '[{"year":1990,"concepts":[["x","0.5"]],"cited_by_count":3}]', 0), ("a", "[]", 1)], "aid string, w string, n int")
    assert R.nested_shards(s, "aid", "w", "n").first()["works"] == []
    up = R.upsert(spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string"), spark.createDataFrame([(1, "new")], "k int, v string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "new"), (2, "keep")}


def test_id_normalisers(spark):
    one = spark.createDataFrame([(" HTTPS://doi.org/10.1/A ", "PMID: 012", "https://orcid.org/0000-0001-2345-678X", "José  Ñandú")], "d string, p string, o string, n string")
    r = one.select(X.norm_doi(F.col("d")), X.norm_digits(F.col("p")), X.norm_orcid(F.col("o")), X.fold_name(F.col("n"))).first()
    assert tuple(r) == ("10.1/a", "012", "0000-0001-2345-678X", "jose nandu")
    assert one.select(X.norm_doi(F.lit("None")), X.norm_digits(F.lit("0")), X.norm_orcid(F.lit("x"))).first() == ("", "", None)


def test_redelivered_stream_files_change_nothing(spark, tmp_path):
    ev = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") + 1704067200).alias("ts"), (F.col("id") % 7).alias("user_id"),
                                 F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    for name in "ab":
        ev.write.parquet(str(tmp_path / "in" / name))
    start_ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "t"), str(tmp_path / "c"), 1).awaitTermination()
    ev.write.parquet(str(tmp_path / "in" / "late"))
    start_ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "t"), str(tmp_path / "c"), 1).awaitTermination()
    t = read_table(spark, str(tmp_path / "t"))
    assert t.count() == 200 and t.agg(F.sum("value")).first()[0] == sum(range(200))


def test_compaction_keeps_the_latest_and_reading_does_not_grow(spark, tmp_path):
    def deliver(name, ids, value):
        (spark.createDataFrame([(i,) for i in ids], "event_id long").select("event_id", F.timestamp_seconds(F.col("event_id") * 9000).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("v").alias("event_type"),
         F.lit(float(value)).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(str(tmp_path / "in" / name)))
        start_ingest(spark, str(tmp_path / "in" / "*"), str(tmp_path / "t"), str(tmp_path / "c"), 1, compact_every=3).awaitTermination()
    want = {}
    for k in range(8):
        ids = list(range(k, 60, 2)) if k % 2 else list(range(60))
        deliver(f"d{k}", ids, k)
        want.update(dict.fromkeys(ids, float(k)))
        assert {r["event_id"]: r["value"] for r in read_table(spark, str(tmp_path / "t")).collect()} == want
    folders = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert folders == ["base=5", "batch=6", "batch=7"]
    (tmp_path / "t" / "base=5" / "_SUCCESS").unlink()  # a base that was not written to the end does not count
    assert {r["event_id"] for r in read_table(spark, str(tmp_path / "t")).collect()} == set(range(60))
