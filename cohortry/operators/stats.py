"""Agreement, association and partition statistics as single aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.operators.ordering import attach, average_ranks, quantiles


def corr(a: Column, b: Column) -> Column:
    """Correlation that is null, not an error, when a side is constant."""
    a, b = a.cast("double"), b.cast("double")
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def kappa(agree: Column, p1: Column, p2: Column) -> Column:
    """Cohen's kappa from observed agreement and the two positive rates; 1 when chance agreement is 1."""
    pe = p1 * p2 + (F.lit(1.0) - p1) * (F.lit(1.0) - p2)
    return F.when(pe >= 1.0, F.lit(1.0)).otherwise((agree - pe) / (F.lit(1.0) - pe))


def confusion(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """2x2 table of two binary columns, agreement and kappa per group."""
    A, B = F.col(a), F.col(b)
    t = df.groupBy(*group).agg(
        F.count_if((A == 1) & (B == 1)).alias("n11"), F.count_if((A == 1) & (B == 0)).alias("n10"),
        F.count_if((A == 0) & (B == 1)).alias("n01"), F.count_if((A == 0) & (B == 0)).alias("n00"))
    n = (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).cast("double")
    agree = (F.col("n11") + F.col("n00")) / n
    k = kappa(agree, (F.col("n11") + F.col("n10")) / n, (F.col("n11") + F.col("n01")) / n)
    return t.select(*group, "n11", "n10", "n01", "n00", agree.alias("agreement"), k.alias("kappa"))


def kappa_reweighted(df: DataFrame, group: Sequence[str], y: str, j: str, target: str) -> DataFrame:
    """Kappa after weighting the classes of ``y`` to a target base rate (a column constant per group)."""
    Y, J = F.col(y).cast("double"), F.col(j).cast("double")
    m = df.groupBy(*group).agg(F.avg(Y).alias("sample_rate"), F.max(target).alias("base"),
                               *[F.avg(F.when((F.col(y) == a) & (F.col(j) == b), 1.0).otherwise(0.0)).alias(f"p{a}{b}")
                                 for a in (0, 1) for b in (0, 1)])
    w1 = F.col("base") / F.greatest(F.col("sample_rate"), F.lit(1e-9))
    w0 = (1 - F.col("base")) / F.greatest(1 - F.col("sample_rate"), F.lit(1e-9))
    total = w1 * F.col("sample_rate") + w0 * (1 - F.col("sample_rate"))
    agree = (w1 * F.col("p11") + w0 * F.col("p00")) / total
    rate_j = (w1 * F.col("p11") + w0 * F.col("p01")) / total
    return m.select(*group, "sample_rate", F.col("base").alias("cohort_rate"), kappa(agree, F.col("base"), rate_j).alias("kappa"))


def spearman(df: DataFrame, group: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks."""
    r = average_ranks(average_ranks(df.select(*group, a, b), group, a, "_ra"), group, b, "_rb")
    return r.groupBy(*group).agg(corr(F.col("_ra"), F.col("_rb")).alias("rho"), F.count(F.lit(1)).alias("n"))


def r2(df: DataFrame, group: Sequence[str], truth: str, pred: str) -> DataFrame:
    """1 - SSE/SST in one pass."""
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    m = df.groupBy(*group).agg(F.sum((t - p) * (t - p)).alias("sse"), F.sum(t * t).alias("tt"), F.sum(t).alias("t"), F.count(t).alias("n"))
    return m.select(*group, (F.lit(1.0) - F.col("sse") / F.nullif(F.col("tt") - F.col("t") * F.col("t") / F.col("n"), F.lit(0.0))).alias("r2"))


def seed_summary(metrics: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation (0 for one seed) and number of seeds."""
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n_seeds"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies) from the contingency counts."""
    cell = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    pa = cell.groupBy(a).agg(F.sum("c").alias("ca"))
    pb = cell.groupBy(b).agg(F.sum("c").alias("cb"))
    n = cell.agg(F.sum("c").cast("double").alias("n"))
    j = attach(cell.join(pa, a).join(pb, b), n, [])
    mi = j.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("mi"))

    def entropy(t, c, name):
        p = F.col(c) / F.col("n")
        return attach(t, n, []).agg((-F.sum(p * F.log(p))).alias(name))
    out = attach(attach(mi, entropy(pa, "ca", "ha"), []), entropy(pb, "cb", "hb"), [])
    mean = (F.col("ha") + F.col("hb")) / 2
    return out.select("mi", "ha", "hb", F.when(mean == 0, F.lit(1.0)).otherwise(F.col("mi") / mean).alias("nmi"))


def modularity(edges: DataFrame, labels: DataFrame, draw: Sequence[str] = ()) -> DataFrame:
    """Modularity of a partition of an undirected simple graph: per-community edge and degree sums.

    ``edges`` (src, dst) once per undirected edge, ``labels`` (node, community); ``draw`` columns
    evaluate many graphs in one job.
    """
    d = list(draw)
    la = labels.select(*d, F.col("node").alias("src"), F.col("community").alias("_a"))
    lb = labels.select(*d, F.col("node").alias("dst"), F.col("community").alias("_b"))
    e = edges.select(*d, "src", "dst").join(la, [*d, "src"]).join(lb, [*d, "dst"])
    ends = e.select(*d, F.explode(F.array(F.struct(F.col("_a").alias("c"), (F.col("_a") == F.col("_b")).cast("int").alias("i")),
                                          F.struct(F.col("_b").alias("c"), F.lit(0).alias("i")))).alias("x"))
    per = ends.groupBy(*d, "x.c").agg(F.count(F.lit(1)).alias("deg"), F.sum("x.i").alias("inner"))
    m2 = F.sum("deg").cast("double")
    out = per.groupBy(*d).agg(m2.alias("m2"), F.sum("inner").cast("double").alias("inner"),
                              F.sum(F.col("deg").cast("double") * F.col("deg")).alias("sq"), F.count(F.lit(1)).alias("n_communities"))
    return out.select(*d, (F.col("inner") / (F.col("m2") / 2) - F.col("sq") / (F.col("m2") * F.col("m2"))).alias("q"), "n_communities")


def quantile_label(df: DataFrame, group: Sequence[str], value: str, cuts: Sequence[float], names: Sequence[str], out: str) -> DataFrame:
    """Label by exact quantile cuts: first name for value <= first cut, and so on."""
    probs = {f"_c{i}": p for i, p in enumerate(cuts)}
    q = quantiles(df, group, value, probs)
    label = F.lit(names[-1])
    for i in reversed(range(len(cuts))):
        label = F.when(F.col(value) <= F.col(f"_c{i}"), names[i]).otherwise(label)
    return attach(df, q, list(group)).withColumn(out, label)


def quantile_bin(df: DataFrame, group: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Quantile bins with duplicate edges dropped; bins are right-closed, the lowest value is in bin 1."""
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    q = quantiles(df, group, value, probs)
    edges = F.array_distinct(F.array(*probs))
    j = attach(df, q, list(group)).withColumn("_edges", edges)
    return j.withColumn(out, F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < F.col(value))))).drop("_edges", *probs)
