"""Citation outcomes: percentiles within a period, h-index, late impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cohortry.operators.ordering import cumulate


def percentile_dim(events: DataFrame, time: str, value: str) -> DataFrame:
    """(time, value, pct): average-tie percentile rank of each distinct value within its period."""
    c = cumulate(events, [time], value, {"n": F.lit(1)}, descending=False)
    return c.select(time, value, ((F.col("cum_n") - (F.col("n") - 1) / F.lit(2.0)) / F.col("tot_n")).alias("pct"))


def h_index(events: DataFrame, key: str, value: str) -> DataFrame:
    """Largest h with h events of value >= h.

    Events are folded to (key, value) counts; an author with any number of events has at most one
    row per distinct value in the window.
    """
    folded = events.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(key).orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    return folded.withColumn("at_least", F.sum("n").over(w)).groupBy(key).agg(
        F.coalesce(F.max(F.least(F.col("at_least"), F.col(value).cast("bigint"))), F.lit(0)).cast("bigint").alias("h_index"))
