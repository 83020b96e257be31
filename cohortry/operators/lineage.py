"""Ancestry over a parent map: two hops, depth with a cycle guard, grand-source profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import jaccard
from cohortry.operators.ordering import first_by

MAX_DEPTH = 12


def parent_map(edges: DataFrame) -> DataFrame:
    """One parent per person: the source of the earliest edge (period, event, id)."""
    return first_by(edges, ["subject"], [F.col("first_period"), F.col("first_event"), F.col("source")], ["source"]).select(
        F.col("subject").alias("pid"), F.col("source").alias("parent"))


def two_hop(rows: DataFrame, parents: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``grand``: the source's own parent, null when it has none."""
    p = parents.select(F.col("pid").alias(source), F.col("parent").alias("grand"))
    return rows.join(p, source, "left")


def ancestor_paths(parents: DataFrame) -> DataFrame:
    """(pid, path of up to 12 ancestors) by path doubling: four joins, whatever the depth."""
    one = parents.select("pid", F.array("parent").alias("path"))

    def extend(left: DataFrame, right: DataFrame, length: int) -> DataFrame:
        r = right.select(F.col("pid").alias("_end"), F.col("path").alias("_more"))
        end = F.when(F.size("path") == length, F.element_at("path", -1))
        return (left.withColumn("_end", end).join(r, "_end", "left")
                .select("pid", F.when(F.col("_more").isNotNull(), F.concat("path", "_more")).otherwise(F.col("path")).alias("path")))
    two = extend(one, one, 1)
    four = extend(two, two, 2)
    eight = extend(four, four, 4)
    return extend(eight, four, 8)


def lineage_depth(paths: DataFrame) -> DataFrame:
    """Hops to the root: stops at a person without parent, at a repeated person, or at 12."""
    nodes = F.concat(F.array("pid"), F.col("path"))
    stop = F.filter(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), lambda i: (
        (i >= F.size("nodes") - 1) & (F.size("nodes") <= MAX_DEPTH)) | (i == MAX_DEPTH)
        | (F.array_position("nodes", F.get("nodes", i)) < i + 1))
    return paths.withColumn("nodes", nodes).select("pid", F.array_min(stop).cast("int").alias("depth"))


def lineage_features(rows: DataFrame, grand_asof: DataFrame) -> DataFrame:
    """Grand-source as-of features of each row; zeros and empty sets when it left nothing by the cut."""
    g = grand_asof.select(F.col("source").alias("grand"), "cut", F.col("prod").alias("g_prod"),
                          F.col("breadth").alias("g_breadth"), F.col("first_period").alias("g_first"), F.col("tags").alias("g_tags"))
    r = rows.join(g, ["grand", "cut"], "left")
    none = F.array().cast("array<string>")
    zero = F.lit(0)
    return r.select(
        *rows.columns,
        F.coalesce("g_prod", zero).alias("grand_prod"), F.coalesce("g_breadth", zero).alias("grand_breadth"),
        F.greatest(F.coalesce(F.col("t0") - F.col("g_first"), zero), zero).alias("grand_age"),
        F.coalesce("g_tags", none).alias("grand_tags"),
        jaccard(F.col("early_tags"), F.col("g_tags")).alias("jac_subject_grand"),
        jaccard(F.col("source_tags"), F.col("g_tags")).alias("jac_source_grand"),
        F.coalesce((F.col("g_prod") > 0).cast("int"), zero).alias("has_grand"))
