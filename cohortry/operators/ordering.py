"""Exact global orderings without a single-partition window.

A plain ``row_number().over(partitionBy(field))`` puts every row of a field into one task. The
helpers below do it in two levels: rows are put into buckets that follow the wanted order, each
bucket is ranked by itself, and the (few) bucket totals are accumulated to give every bucket its
offset. The result equals the plain window exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hash_rank(df: DataFrame, group: Sequence[str], digest: str, tie: Sequence[str] = (),
              out: str = "rn", hex_digits: int | str = 3, size: str | None = None) -> DataFrame:
    """1-based rank of each row in the order of an md5 column, per group.

    The bucket is the leading ``hex_digits`` of the digest, so buckets are even by construction
    however skewed the groups are (3 digits = 4,096 buckets per group; raise it with the data). A column
    name instead of a number gives every group its own digits (``bucket_digits``); the column is dropped.
    The bucket totals meet rows that the ranking has sorted by bucket already, so they are merged, never
    broadcast: many groups have as many totals as rows. ``size`` also returns the group size.
    """
    group = list(group)
    rows = df.withColumn("__b", F.substring(F.col(digest), F.lit(1), F.col(hex_digits) if isinstance(hex_digits, str) else F.lit(hex_digits)))
    rows = (rows.drop(hex_digits) if isinstance(hex_digits, str) else rows).withColumn("__h", F.unhex(digest))
    totals = rows.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offs = totals.withColumn("__off", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    if size:
        offs = offs.withColumn(size, F.sum("__n").over(W.partitionBy(*group)))
    offs = offs.drop("__n")
    local = W.partitionBy(*group, "__b").orderBy("__h", *tie)
    ranked = rows.withColumn("__rn", F.row_number().over(local)).drop("__h")
    return (ranked.join(offs.hint("merge"), group + ["__b"])
            .withColumn(out, (F.col("__rn") + F.col("__off")).cast("bigint"))
            .drop("__b", "__rn", "__off"))


def bucket_digits(n: Column) -> Column:
    """Digits for ``hash_rank`` that put 256 to 4,096 rows of a group of ``n`` into a bucket (all of a smaller group)."""
    return F.when(n <= 1 << 12, 0).when(n <= 1 << 16, 1).when(n <= 1 << 20, 2).when(n <= 1 << 24, 3).when(n <= 1 << 28, 4).otherwise(5)


def cumulate(df: DataFrame, group: Sequence[str], by: str, sums: dict[str, Column],
             descending: bool = True, bins: int = 256) -> DataFrame:
    """One row per (group, distinct ``by``) with sums and their running totals in ``by`` order.

    Rows are first aggregated per distinct value (map-side combine), so a hot group costs its
    distinct values only; those are then accumulated in ``bins`` slices. The slices end at quantiles of the
    distinct values, so they are even whatever the values; raise ``bins`` with the data.
    Adds ``cum_<name>`` (inclusive) and ``tot_<name>`` for every name in ``sums``.
    """
    group = list(group)
    agg = df.groupBy(*group, by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ends = agg.groupBy(*group).agg(F.percentile_approx(by, [i / bins for i in range(1, bins)], 10 * bins).alias("_ends"))
    wide = math.isqrt(bins - 1) + 1
    ends = ends.withColumn("_ends", F.array(*[F.slice("_ends", i + 1, wide) for i in range(0, bins - 1, wide)]))
    passed = F.size(F.filter("_ends", lambda e: F.element_at(e, -1) < F.col(by)))  # whole runs of ends below the value, then ends of the next run
    agg = attach(agg, ends, group).withColumn("_p", passed).withColumn("_b", F.col("_p") * wide + F.coalesce(F.size(F.filter(F.get("_ends", F.col("_p")), lambda e: e < F.col(by))), F.lit(0))).drop("_ends", "_p")
    per_bin = agg.groupBy(*group, "_b").agg(*[F.sum(n).alias(f"_s_{n}") for n in sums])
    key = F.col("_b").desc() if descending else F.col("_b").asc()
    before = _window(group).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    whole = _window(group)
    offs = per_bin.select(
        *group, "_b",
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(f"tot_{n}") for n in sums])
    order = F.col(by).desc() if descending else F.col(by).asc()
    local = _window(group + ["_b"]).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = agg.select(*group, "_b", by, *sums, *[F.sum(n).over(local).alias(f"_l_{n}") for n in sums])
    out = out.join(offs, group + ["_b"])
    return out.select(
        *group, by, *sums,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums],
        *[f"tot_{n}" for n in sums])


def _window(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def attach(df: DataFrame, per_group: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join one row per group. With no group the right side is one aggregate row: it becomes a scalar
    subquery, so there is no join and the left side is not moved."""
    if group:
        return df.join(per_group, list(group), "inner")
    row = per_group.select(F.struct(*per_group.columns).alias("_one")).scalar()
    return df.withColumn("_one", row).select(*df.columns, "_one.*")


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float],
              bins: int = 256) -> DataFrame:
    """Exact linear-interpolation quantiles per group, in value order, without collecting a group.

    Position ``p*(n-1)`` falls between two neighbours; both are found from running counts.
    """
    group = list(group)
    cum = cumulate(df.where(F.col(value).isNotNull()), group, value, {"n": F.lit(1)},
                   descending=False, bins=bins)
    last = F.col("cum_n") - 1
    first = F.col("cum_n") - F.col("n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("tot_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((first <= lo) & (last >= lo), F.col(value))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((first <= hi) & (last >= hi), F.col(value))).alias(f"_hi_{name}"))
        aggs.append(F.max(pos - lo).alias(f"_fr_{name}"))
    out = cum.groupBy(*group).agg(*aggs)
    return out.select(*group, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).cast("double").alias(n)
        for n in probs])


def average_ranks(df: DataFrame, group: Sequence[str], value: str, out: str,
                  bins: int = 256) -> DataFrame:
    """Average ranks (ties share the mean rank) of ``value`` per group."""
    group = list(group)
    cum = cumulate(df, group, value, {"_one": F.lit(1)}, descending=False, bins=bins)
    ranks = cum.select(*group, value,
                       (F.col("cum__one") - (F.col("_one") - 1) / F.lit(2.0)).alias(out),
                       F.col("tot__one").alias(f"{out}_n"))
    return df.join(ranks, group + [value], "inner")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """First row per key in an explicit total order: an aggregate with map-side combine, not a window."""
    pick = F.min_by(F.struct(*keep), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """At most k rows per key. Spark limits each map partition to k rows per key before the shuffle; it
    does so up to 1000, so a larger k is first limited inside 32 salted slices of each key."""
    rows = df
    if k > 1000:
        salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(32))
        w = _window([*keys, "_salt"]).orderBy(*order)
        rows = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_salt", "_r")
    w = _window(keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
