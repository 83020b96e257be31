"""The one streaming job: file stream -> merge -> de-duplicate on reading."""

from pyspark.sql import functions as F

from cohortry.plans import stages as S
from cohortry.plans.ingest import scratch
from cohortry.plans.registry import query
from cohortry.streaming.ingest import read_table, start_ingest


@query("stream_event_ingest", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_event_ingest(spark, sf):
    """The later half of the events arrives first, the earlier half weeks too late, and the later half once
    more; the table holds each event once."""
    root = scratch(spark, "stream")
    ev = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mid = ev.agg(F.expr("percentile_approx(event_id, 0.5)").alias("m")).first()["m"]
    first, rest = ev.where(F.col("event_id") <= mid), ev.where(F.col("event_id") > mid)
    rest.write.parquet(f"{root}/in/a")
    first.write.parquet(f"{root}/in/b")
    rest.write.parquet(f"{root}/in/c")
    q = start_ingest(spark, f"{root}/in/*", f"{root}/table", f"{root}/state", max_files=1, compact_every=2)
    q.awaitTermination()
    return read_table(spark, f"{root}/table").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))
