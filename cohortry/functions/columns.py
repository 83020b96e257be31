"""Column expressions shared by all operators. Everything here stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two tag arrays; 0.0 when either is empty or absent."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(
        F.when((F.size(a) > 0) & (F.size(b) > 0),
               F.size(F.array_intersect(a, b)).cast("double") / union.cast("double")),
        F.lit(0.0),
    )


def keyed_md5(*parts) -> Column:
    """The draw key: depends on (seed, salt, row key) only, never on row order or partitioning."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def uniform(md5_hex: Column) -> Column:
    """A number in [0, 1) from the first eight hex digits of a draw key."""
    return F.conv(F.substring(md5_hex, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_int(md5_hex: Column) -> Column:
    """A non-negative bigint from the first twelve hex digits of a draw key."""
    return F.conv(F.substring(md5_hex, 1, 12), 16, 10).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Double division, null for an empty group."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def render(tags: Column) -> Column:
    return F.array_join(tags, "; ")


def r6(col: Column) -> Column:
    return F.round(col.cast("double"), 6)
