"""Row predicates and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.specs import FeatureSpec

# fixed values: spellings that mean "absent"
NULL_WORDS = ("NULL", "None", "")
ID_NULL_WORDS = ("", "nan", "0", "none")


def id_tail(url: Column) -> Column:
    """Last path segment of an id URL."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def first_token(listing: Column) -> Column:
    """First non-blank entry of a comma list."""
    return F.get(F.filter(F.transform(F.split(listing, ","), lambda x: F.trim(x)), lambda x: x != ""), 0)


def nullify(value: Column, words: Sequence[str] = NULL_WORDS) -> Column:
    return F.when(~value.isin(*words), value)


def in_window(value: Column, lo: Column | int | None, hi: Column | int | None) -> Column:
    """Inclusive window, open on a side given as None; null never passes."""
    ok = value.isNotNull()
    if lo is not None:
        ok = ok & (value >= lo)
    if hi is not None:
        ok = ok & (value <= hi)
    return ok


def standardise(df: DataFrame, column: str, synonyms: DataFrame, out: str) -> DataFrame:
    """Map known spellings, pass the rest through. ``synonyms`` has (spelling, standard)."""
    return (df.join(synonyms.withColumnRenamed("spelling", column), column, "left")
            .withColumn(out, F.coalesce("standard", column)).drop("standard"))


def both_ends(edges: DataFrame, persons: DataFrame, wanted: str) -> DataFrame:
    """Edges of relation 1 with two usable ids whose ends both list the wanted category."""
    ok = persons.where(F.array_contains(F.transform(F.split("categories", ","), lambda x: F.trim(x)), wanted)).select("pid")
    usable = lambda c: ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0")
    e = edges.where((F.col("relation") == 1) & usable("subject") & usable("source"))
    return (e.join(ok.withColumnRenamed("pid", "subject"), "subject", "left_semi")
            .join(ok.withColumnRenamed("pid", "source"), "source", "left_semi"))


def project_features(df: DataFrame, keys: Sequence[str], spec: FeatureSpec, drop: tuple[str, ...] = ()) -> DataFrame:
    """Ordered feature columns as doubles. Fails while the plan is built if a banned name is asked for."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in spec.columns(drop)])
