"""Paired tests, multiplicity, resampling intervals and decision gates on metric tables.

Tests here compare the seeds of one comparison; the arrays below hold one entry per seed, or per rank sum
of the seeds, and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.functions.columns import hash_int, keyed_md5
from cohortry.operators.ordering import quantiles

# fixed values: two-sided 95 % points of Student's t for 1..30 degrees of freedom
T95 = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
       2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042)


def paired_differences(metrics: DataFrame, keys: Sequence[str], model: str, pairs: Sequence[tuple[str, str]], value: str = "value") -> DataFrame:
    """(keys, a, b, seed, d) for named pairs of models, paired by seed."""
    p = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    m = metrics.select(*keys, "seed", F.col(model).alias("_m"), F.col(value).alias("_v"))
    left = m.withColumn("p", F.explode(F.filter(p, lambda x: x["a"] == F.col("_m")))).select(*keys, "seed", "p.a", "p.b", F.col("_v").alias("va"))
    right = m.select(*keys, "seed", F.col("_m").alias("b"), F.col("_v").alias("vb"))
    return left.join(right, [*keys, "seed", "b"]).select(*keys, "a", "b", "seed", "va", "vb", F.round(F.col("va") - F.col("vb"), 6).alias("d"))


def signed_ranks(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-zero differences with the average rank of their size."""
    z = diffs.where(F.col("d") != 0).withColumn("_a", F.abs("d"))
    w = W.partitionBy(*keys).orderBy("_a")
    ties = W.partitionBy(*keys, "_a")
    return z.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)).drop("_a")


def wilcoxon(diffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two-sided signed-rank test with the exact null; p = 1 when nothing differs.

    The null counts the sign patterns of every rank sum without listing them: ranks are doubled, so that
    shared ranks are whole too, and added one by one to an array of counts per sum (n * n(n+1) cells).
    """
    r = signed_ranks(diffs, keys).groupBy(*keys).agg(
        F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"),
        F.sort_array(F.collect_list("rank")).alias("_r"))
    twice = F.transform("_r", lambda x: F.round(2 * x).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.aggregate(twice, F.lit(0), lambda a, x: a + x)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(twice, cells, lambda c, x: F.transform(c, lambda v, i: v + F.when(i >= x, F.get(c, i - x)).otherwise(0.0)))
    r = r.withColumn("_s", F.transform(counts, lambda v, i: F.struct(i.alias("w"), v.alias("n"))))

    def share(keep):
        return F.aggregate(F.filter("_s", keep), F.lit(0.0), lambda a, e: a + e["n"]) / F.pow(F.lit(2.0), F.size("_r"))
    at = F.round(2 * F.col("w_plus")).cast("int")
    le, ge = share(lambda e: e["w"] <= at), share(lambda e: e["w"] >= at)
    r = r.withColumn("p", F.least(F.lit(1.0), 2 * F.least(le, ge))).select(*keys, "w_plus", "w_minus", "p")
    base = diffs.groupBy(*keys).agg(F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd_diff"), F.count("d").alias("n"),
                                    F.count_if(F.col("d") > 0).alias("n_pos"), F.count_if(F.col("d") < 0).alias("n_neg"), F.var_pop("vb").alias("var_b"))
    z = F.lit(0.0)
    return base.join(r, list(keys), "left").withColumn("p", F.coalesce("p", F.lit(1.0))).withColumn("w_plus", F.coalesce("w_plus", z)).withColumn("w_minus", F.coalesce("w_minus", z))


def bh(tests: DataFrame, family: Sequence[str], order: Sequence[str], p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg inside each family: p*m/rank, running minimum from the largest p, clipped at 1."""
    fam = W.partitionBy(*family)
    up = fam.orderBy(F.col(p), *order)
    down = fam.orderBy(F.col(p).desc(), *[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    raw = F.col(p) * F.count(F.lit(1)).over(fam) / F.row_number().over(up)
    return tests.withColumn("_raw", raw).withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def cohens_d(mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, mean / sd).otherwise(F.signum(mean) * F.lit(float("inf")))


def t_critical(n: Column) -> Column:
    """Two-sided 95 % point of Student's t for n - 1 degrees of freedom: tabled up to 30, beyond by its
    expansion around the normal point, which is right to five digits there."""
    table = F.array(*[F.lit(v) for v in T95])
    z, v = 1.959963984540054, (n - 1).cast("double")
    beyond = (z + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / v**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / v**3)
    return F.coalesce(F.get(table, (n - 2).cast("int")), beyond)


def seed_bootstrap(diffs: DataFrame, keys: Sequence[str], draws: int, salt: str = "seedboot") -> DataFrame:
    """Percentile interval of the mean over resampled seeds, and the t interval."""
    n = diffs.groupBy(*keys).agg(F.max("seed").alias("_hi"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("_sd"), F.count("d").alias("_n"))
    slots = diffs.select(*keys, "seed").join(n.select(*keys, "_hi"), list(keys)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.select(*keys, "draw", F.pmod(hash_int(keyed_md5(F.col("draw"), salt, F.col("seed"))), F.col("_hi") + 1).cast("int").alias("seed"))
    means = picks.join(diffs.select(*keys, "seed", "d"), [*keys, "seed"]).groupBy(*keys, "draw").agg(F.avg("d").alias("m"))
    q = quantiles(means.withColumn("m", F.round("m", 9)), keys, "m", {"lo": 0.025, "hi": 0.975})
    half = t_critical(F.col("_n")) * F.col("_sd") / F.sqrt("_n")
    return n.join(q, list(keys)).select(*keys, "mean_diff", "lo", "hi", (F.col("mean_diff") - half).alias("t_lo"), (F.col("mean_diff") + half).alias("t_hi"))


def gates(mean: Column, ceiling: Column, p_adj: Column, ci_low: Column) -> dict[str, Column]:
    """Three gates; a model exceeds only if all hold."""
    a, b, c = mean > ceiling, p_adj < 0.05, ci_low > 0
    return {"gate_mean": a, "gate_p": b, "gate_ci": c, "exceeds": a & b & c}


def branch(best: Column, m1: Column, band: Column, ci_lo: Column, ci_hi: Column, margin: float = 0.05) -> Column:
    """A: the best one-sided model stays at or below band + margin while the paired interval is above 0;
    B: the interval holds 0 or the best comes within margin of m1; C otherwise. A is tried first."""
    return (F.when((best <= band + margin) & (ci_lo > 0), "A").when(((ci_lo <= 0) & (ci_hi >= 0)) | (best >= m1 - margin), "B").otherwise("C"))
