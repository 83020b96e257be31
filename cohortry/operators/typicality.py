"""How ordinary a profile is: overlap with the most frequent tags of a field or of nearby cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import jaccard
from cohortry.operators.ordering import attach, top_k


def frequent_tags(rows: DataFrame, group: Sequence[str], tags: str, k: int = 10) -> DataFrame:
    """The k tags held by most rows per group (ties by name), as one array of at most k."""
    df = rows.select(*group, F.explode(tags).alias("tag")).groupBy(*group, "tag").agg(F.count(F.lit(1)).alias("n"))
    best = top_k(df, group, [F.col("n").desc(), F.col("tag")], k)
    return best.groupBy(*group).agg(F.sort_array(F.collect_list("tag")).alias("frequent"))


def typicality(rows: DataFrame, group: Sequence[str], tags: str, pool: str, out: str, k: int = 10) -> DataFrame:
    """Overlap of ``tags`` with the group's most frequent ``pool`` tags."""
    return attach(rows, frequent_tags(rows, group, pool, k), list(group)).withColumn(out, jaccard(F.col(tags), F.col("frequent"))).drop("frequent")


def cohort_typicality(rows: DataFrame, group: Sequence[str], time: str, tags: str, out: str, band: int = 3, k: int = 10) -> DataFrame:
    """The same with tags pooled over cohorts within +-band periods.

    Tag counts per (time, tag) are spread over the band, not rows.
    """
    g = list(group)
    counts = rows.select(*g, time, F.explode(tags).alias("tag")).groupBy(*g, time, "tag").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.select(*g, F.explode(F.sequence(F.col(time) - band, F.col(time) + band)).alias(time), "tag", "n")
    pooled = spread.groupBy(*g, time, "tag").agg(F.sum("n").alias("n"))
    best = top_k(pooled, [*g, time], [F.col("n").desc(), F.col("tag")], k)
    arr = best.groupBy(*g, time).agg(F.sort_array(F.collect_list("tag")).alias("frequent"))
    return rows.join(arr, [*g, time], "left").withColumn(out, jaccard(F.col(tags), F.col("frequent"))).drop("frequent")


def concentration(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of squared tag shares from (keys, tag, n) counts."""
    n = F.sum(F.col("n").cast("double"))
    return counts.groupBy(*keys).agg((F.sum(F.col("n").cast("double") * F.col("n")) / (n * n)).alias("concentration"))
