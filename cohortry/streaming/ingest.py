"""Incremental event ingest: re-delivered files and repaired rows are harmless, and do not make reading dearer.

A table is a folder of ``base=N`` (one row per event id, all deliveries up to batch N merged) and of ``batch=M``
(what came after it). Every few batches the newest base and the batches behind it are merged into a new base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
STORED = T.StructType(EVENTS.fields + [T.StructField("day", T.DateType())])


def start_ingest(spark: SparkSession, source: str, table: str, checkpoint: str, max_files: int = 100, compact_every: int = 8):
    """Read landed parquet files as a stream and merge every micro-batch into the event table, one folder
    per day and batch.

    A batch writes only its own ``batch`` folder, and overwrites it when it is replayed, so a
    failed and repeated batch leaves the same table. Every delivery is written, however late; that an
    event id counts once, and that the later batch wins, is the one rule of ``read_table``. After every ``compact_every``
    batches the table is compacted, so that a read touches an event once and a few recent deliveries besides.
    """
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        if number > _newest_base(spark, table):  # else a replay of what a base holds already
            (batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").option("maxRecordsPerFile", 2_000_000)
             .partitionBy("day").parquet(f"{table}/batch={number}"))
        if (number + 1) % compact_every == 0:
            compact(spark, table, number)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbers(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the folders of a kind that were written to the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{n}/_SUCCESS")))


def _newest_base(spark: SparkSession, table: str) -> int:
    return max(_numbers(spark, table, "base"), default=-1)


def compact(spark: SparkSession, table: str, upto: int) -> None:
    """Merge the newest base and the batches up to ``upto`` into ``base=upto``, then delete what it holds. Until the new base
    is written to the end the old folders are the table; when it is, they no longer count, deleted or not."""
    if _newest_base(spark, table) >= upto:
        return
    merged = _latest(spark, table, upto).repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(4)))
    merged.write.mode("overwrite").option("maxRecordsPerFile", 2_000_000).partitionBy("day").parquet(f"{table}/base={upto}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f"base={n}" for n in _numbers(spark, table, "base") if n < upto] + [f"batch={n}" for n in _numbers(spark, table, "batch") if n <= upto]
    for name in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{name}"), True)


def _latest(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """One row per event id. Only the ids that recent batches hold are grouped; the rest of the base is passed through."""
    base = _newest_base(spark, table)
    late = [n for n in _numbers(spark, table, "batch") if n > base and (upto is None or n <= upto)]
    cols = [f.name for f in STORED.fields]

    def folder(name: str) -> DataFrame:
        return spark.read.schema(STORED).parquet(f"{table}/{name}").select(*cols)
    held = folder(f"base={base}") if base >= 0 else None
    if not late:
        return held if held is not None else spark.createDataFrame([], STORED)
    parts = [folder(f"batch={n}").withColumn("batch", F.lit(n)) for n in late]
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    new = new.groupBy("event_id").agg(F.max_by(F.struct(*cols[1:]), "batch").alias("r")).select("event_id", "r.*")
    return new if held is None else held.join(new.select("event_id"), "event_id", "left_anti").select(*cols).unionByName(new)


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The merged table: one row per event id, the latest batch wins."""
    return _latest(spark, table).select(*[f.name for f in EVENTS.fields])
