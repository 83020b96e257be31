"""Same-source peers under time rules. Always linear: rows are folded to (source, t0) first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F


# sums are decimal, so they do not depend on the order in which partitions arrive
EXACT = "decimal(20,6)"


def _running(folded: DataFrame, group: Sequence[str], time: str, sums: Sequence[str], upto: int, prefix: str) -> DataFrame:
    w = W.partitionBy(*group).orderBy(time).rangeBetween(W.unboundedPreceding, upto)
    return folded.select(*group, time, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{prefix}{s}") for s in sums])


def peer_sums(rows: DataFrame, group: Sequence[str], time: str, values: Sequence[str], upto: int,
              prefix: str) -> DataFrame:
    """Adds, per row, count and sums over peers with ``time_j <= time_i + upto`` (the row itself included
    when ``upto >= 0``).

    One partial aggregate folds a hub to at most one row per period; the RANGE window then runs over
    those, and the result is joined back on (group, time).
    """
    folded = rows.groupBy(*group, time).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(v).cast(EXACT)).alias(v) for v in values])
    run = _running(folded, group, time, ["n", *values], upto, prefix)
    return rows.join(run, [*group, time])


def peer_aggregates(rows: DataFrame, source: str = "source", time: str = "t0", lag: int = 10) -> DataFrame:
    """Prior peers (t0_j <= t0_i): count and mean overlap, productivity, breadth. Closed peers
    (t0_j + 15 <= t0_i + 5): count and mean label. Means are -1 and counts 0 without a peer.

    The row itself is inside the prior frame, so its own values are subtracted; a closed frame never
    holds it.
    """
    vals = ["early_overlap", "early_prod", "early_breadth"]
    a = peer_sums(rows, [source], time, vals, 0, "p_")
    a = peer_sums(a, [source], time, ["y"], -lag, "c_")
    n = F.col("p_n") - 1

    def mean_without_self(v):
        return F.when(n > 0, (F.col(f"p_{v}") - F.col(v).cast(EXACT)).cast("double") / n).otherwise(F.lit(-1.0))
    return a.select(
        *rows.columns,
        n.cast("bigint").alias("peer_n_prior"),
        mean_without_self("early_overlap").alias("peer_overlap_mean"),
        mean_without_self("early_prod").alias("peer_prod_mean"),
        mean_without_self("early_breadth").alias("peer_breadth_mean"),
        F.when(F.col("c_n") > 0, F.col("c_y").cast("double") / F.col("c_n")).otherwise(F.lit(-1.0)).alias("peer_track_record"),
        F.col("c_n").cast("bigint").alias("peer_n_closed"))


def sibling_blocks(rows: DataFrame, source: str = "source", time: str = "t0", prior_only: bool = True) -> DataFrame:
    """Sibling edges in factored form: one row per (source, from-cohort, to-cohort) with its edge count.

    Every member of the from-cohort points to every member of the to-cohort (not to itself). The
    list of single edges grows with the square of a hub; the blocks grow with its periods only, and
    joined to (source, t0) membership they say exactly the same.
    """
    b = rows.groupBy(source, time).agg(F.count(F.lit(1)).alias("n"))
    frm = b.select(F.col(source).alias("_s"), F.col(time).alias("t_from"), F.col("n").alias("n_from"))
    to = b.select(source, F.col(time).alias("t_to"), F.col("n").alias("n_to"))
    on = F.col("_s") == F.col(source)
    if prior_only:
        on = on & (F.col("t_from") <= F.col("t_to"))
    j = to.join(frm, on).drop("_s")
    same = F.col("t_from") == F.col("t_to")
    return (j.withColumn("n_edges", F.col("n_from") * F.col("n_to") - F.when(same, F.col("n_from")).otherwise(0))
            .where(F.col("n_edges") > 0).select(source, "t_from", "t_to", "n_from", "n_to", "n_edges"))


def band_counts(rows: DataFrame, group: Sequence[str], member: str, time: str, band: int) -> DataFrame:
    """Per row, how many rows of other members lie within +-band periods (the size of its draw pool)."""
    g = list(group)
    cell = rows.groupBy(*g, time, member).agg(F.count(F.lit(1)).alias("n"))
    spread = cell.select(*g, F.explode(F.sequence(F.col(time) - band, F.col(time) + band)).alias("_t"), member, "n")
    own = spread.groupBy(*g, "_t", member).agg(F.sum("n").alias("own"))
    pool = spread.groupBy(*g, "_t").agg(F.sum("n").alias("pool"))
    r = rows.withColumn("_t", F.col(time))
    return (r.join(pool, [*g, "_t"]).join(own, [*g, "_t", member])
            .withColumn("pool_size", (F.col("pool") - F.col("own")).cast("bigint")).drop("_t", "pool", "own"))
