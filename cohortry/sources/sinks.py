"""Writers. Every sink writes from the executors and can be repeated without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def flatten_lists(df: DataFrame, sep: str = "; ") -> DataFrame:
    """Array columns as joined text, the CSV twin of a frozen table."""
    return df.select(*[F.array_join(c, sep).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def frozen_table(df: DataFrame, folder: str, by: str | None = None) -> None:
    """Parquet plus a flattened CSV twin, where a null is ``\\N`` and an empty list is empty."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(f"{folder}/parquet")
    flatten_lists(df).write.mode("overwrite").option("header", True).option("nullValue", "\\N").csv(f"{folder}/csv")


def event_table(df: DataFrame, folder: str, rows_per_file: int = 2_000_000) -> None:
    """The canonical fact table: fixed schema, zstd, bounded file size."""
    (df.selectExpr("cast(author_id as string) author_id", "cast(publication_year as smallint) publication_year",
                   "cast(concept as string) concept", "cast(score as float) score")
     .write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(folder))


def nested_metrics(long: DataFrame, keys: list[str]) -> DataFrame:
    """Long metric rows to one JSON document per key."""
    return long.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))).alias("document"))
