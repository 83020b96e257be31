"""Landed files to typed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

EVENT_TABLE = T.StructType([
    T.StructField("author_id", T.StringType()), T.StructField("publication_year", T.ShortType()),
    T.StructField("concept", T.StringType()), T.StructField("score", T.FloatType())])

WORKS = T.ArrayType(T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("concepts", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("cited_by_count", T.IntegerType())]))

LINKS = ("pid", "pubid", "pmid", "doi", "score_total")


def columns_of(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Parquet read of a named column subset (the scan reads no other column)."""
    return spark.read.parquet(path).select(*names)


def delimited_dump(spark: SparkSession, glob: str, columns: dict[str, str]) -> DataFrame:
    """Compressed CSV files addressed by header name, in any column order.

    Bad bytes decode to the replacement character, fields may be 10 MB long, and a value that
    does not parse becomes null instead of failing the row.
    """
    raw = (spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE")
           .option("multiLine", False).option("maxCharsPerColumn", 10_000_000).option("escape", '"').csv(glob))
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in columns.items()])


def links(spark: SparkSession, path: str) -> DataFrame:
    """The link dump behind one reader: a parquet folder, a folder of csv.gz, or a single file of either."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    if any(n.endswith(".parquet") for n in names):
        df = spark.read.parquet(path).select("pid", "pubid", "pmid", "doi", F.col("score_total").cast("double").alias("score_total"))
    else:
        df = delimited_dump(spark, path, {"pid": "string", "pubid": "string", "pmid": "string", "doi": "string", "score_total": "double"})
    return df.withColumn("score_total", F.coalesce("score_total", F.lit(0.0)))


def jsonl_last_wins(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Append-only JSON lines: malformed lines are skipped, the last line of a key wins.

    Place in the store = (file, split offset, row within the split), fixed at the scan.
    """
    raw = spark.read.text(path).select(
        F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"),
                 F.monotonically_increasing_id().alias("i")).alias("place"))
    ok = raw.where(F.col(f"r.{key}").isNotNull())
    return ok.groupBy(F.col(f"r.{key}").alias(key)).agg(F.max_by("r", "place").alias("r")).select("r.*")


def nested_shards(shards: DataFrame, key: str, payload: str, shard_no: str, schema=WORKS) -> DataFrame:
    """JSON payload shards to typed rows; a later shard of the same key overrides."""
    last = shards.groupBy(key).agg(F.max_by(payload, shard_no).alias(payload), F.max(shard_no).alias(shard_no))
    return last.select(key, shard_no, F.from_json(payload, schema).alias("works"))


def upsert(stored: DataFrame, repaired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``repaired`` replace rows of ``stored`` with the same key."""
    return stored.join(repaired.select(*keys), list(keys), "left_anti").unionByName(repaired)


def outstanding(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys wanted minus keys already stored."""
    return wanted.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti")


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """(file, sha256) of every file under a folder, computed where the file is read."""
    return spark.read.format("binaryFile").load(glob).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def row_fingerprint(df: DataFrame, rendered: Sequence[Column]) -> DataFrame:
    """Order-free content fingerprint: row count and the sum of a 32-bit row digest."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *rendered)), 1, 8), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest.cast("decimal(20,0)")).cast("string").alias("fingerprint"))
