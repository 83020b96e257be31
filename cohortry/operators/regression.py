"""Least squares and logit inference from aggregated moments.

A row is a short list of (column, value) entries; only the k x k moment tables (k = number of
columns) reach the driver, where a small system is solved.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def design(rows: DataFrame, numeric: dict[str, Column], dummies: Sequence[str] = ()) -> DataFrame:
    """Adds ``x``: non-zero entries of the row, an intercept first, then columns and dummy levels."""
    e = [F.struct(F.lit("_intercept").alias("c"), F.lit(1.0).alias("v"))]
    e += [F.struct(F.lit(n).alias("c"), col.cast("double").alias("v")) for n, col in numeric.items()]
    e += [F.struct(F.concat(F.lit(f"{d}="), F.col(d).cast("string")).alias("c"), F.lit(1.0).alias("v")) for d in dummies]
    return rows.withColumn("x", F.filter(F.array(*e), lambda s: s["v"] != 0))


def moments(d: DataFrame, weight: Column) -> tuple[list[str], np.ndarray]:
    """Weighted X'X by summing the entry pairs of each row."""
    p = d.select("x", weight.cast("double").alias("_w"), F.explode("x").alias("a")).select("a", "_w", F.explode("x").alias("b"))
    g = p.where("a.c <= b.c").groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v") * F.col("_w")).alias("s")).collect()
    names = sorted({r["i"] for r in g} | {r["j"] for r in g})
    ix = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in g:
        m[ix[r["i"]], ix[r["j"]]] = m[ix[r["j"]], ix[r["i"]]] = r["s"]
    return names, m


def cross(d: DataFrame, target: Column, names: list[str]) -> np.ndarray:
    g = d.select(target.cast("double").alias("_y"), F.explode("x").alias("a")).groupBy(F.col("a.c").alias("i")).agg(F.sum(F.col("a.v") * F.col("_y")).alias("s")).collect()
    v = {r["i"]: r["s"] for r in g}
    return np.array([v.get(n, 0.0) for n in names])


def independent(names: list[str], m: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns kept when each is added in order only if it is not spanned by those before it."""
    order = sorted(range(len(names)), key=lambda i: (names[i] != "_intercept", "=" in names[i], names[i]))
    kept: list[int] = []
    for i in order:
        t = kept + [i]
        sub = m[np.ix_(t, t)]
        scale = np.sqrt(np.outer(np.diag(sub), np.diag(sub)))
        if np.all(np.diag(sub) > 0) and np.linalg.eigvalsh(sub / scale)[0] > tol:
            kept = t
    return kept


def linear_score(names: Sequence[str], beta: Sequence[float]) -> Column:
    """x . beta as an expression over the entry list."""
    table = F.create_map(*[y for n, b in zip(names, beta) for y in (F.lit(n), F.lit(float(b)))])
    return F.aggregate("x", F.lit(0.0), lambda acc, s: acc + s["v"] * F.coalesce(F.try_element_at(table, s["c"]), F.lit(0.0)))


def cluster_meat(d: DataFrame, cluster: str | None, resid: Column, names: list[str]) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer product of their score vectors; without a cluster every row is one."""
    ix = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    if cluster is None:
        p = d.withColumn("_e", resid).select("x", "_e", F.explode("x").alias("a")).select("a", "_e", F.explode("x").alias("b"))
        g = p.groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v") * F.col("_e") * F.col("_e")).alias("s")).collect()
        n = d.count()
    else:
        u = d.withColumn("_e", resid).select(cluster, "_e", F.explode("x").alias("a")).groupBy(cluster, F.col("a.c").alias("c")).agg(F.sum(F.col("a.v") * F.col("_e")).alias("u"))
        v = u.groupBy(cluster).agg(F.collect_list(F.struct("c", "u")).alias("s"))  # one entry per column
        p = v.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b"))
        g = p.groupBy(F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("a.u") * F.col("b.u")).alias("s")).collect()
        n = d.select(cluster).distinct().count()
    for r in g:
        if r["i"] in ix and r["j"] in ix:
            m[ix[r["i"]], ix[r["j"]]] = r["s"]
    return m, n


def ols(rows: DataFrame, target: str, numeric: dict[str, Column], dummies: Sequence[str] = (), cluster: str | None = None) -> list[tuple]:
    """(name, coefficient, robust standard error, rows) of the numeric columns."""
    d = design(rows, numeric, dummies)
    names, m = moments(d, F.lit(1.0))
    keep = independent(names, m)
    names, m = [names[i] for i in keep], m[np.ix_(keep, keep)]
    inv = np.linalg.inv(m)
    beta = inv @ cross(d, F.col(target), names)
    n = int(round(m[names.index("_intercept"), names.index("_intercept")]))
    meat, g = cluster_meat(d, cluster, F.col(target) - linear_score(names, beta), names)
    k = len(names)
    fix = (n / (n - k)) if cluster is None else (g / max(g - 1, 1)) * ((n - 1) / (n - k))
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv) * fix, 0))
    return [(nm, float(b), float(s), n) for nm, b, s in zip(names, beta, se) if nm in numeric]


def logit(rows: DataFrame, target: str, numeric: dict[str, Column], dummies: Sequence[str] = (), cluster: str | None = None, rounds: int = 12) -> list[tuple]:
    """Logit of a target in [0, 1] (fractions allowed) by Newton steps on aggregated moments, with a
    sandwich error (HC1, or clustered)."""
    d = design(rows, numeric, dummies)
    names, m = moments(d, F.lit(1.0))
    keep = independent(names, m)
    names = [names[i] for i in keep]
    beta = np.zeros(len(names))
    n = d.count()
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-linear_score(names, beta)))
        hn, h = moments(d, mu * (1 - mu))
        sel = [hn.index(x) for x in names]
        h = h[np.ix_(sel, sel)]
        step = np.linalg.solve(h, cross(d, F.col(target) - mu, names))
        beta = beta + step
        if np.max(np.abs(step)) < 1e-8:
            break
    mu = 1 / (1 + F.exp(-linear_score(names, beta)))
    meat, g = cluster_meat(d, cluster, F.col(target) - mu, names)
    inv = np.linalg.inv(h)
    k = len(names)
    fix = (n / (n - k)) if cluster is None else (g / max(g - 1, 1)) * ((n - 1) / (n - k))
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv) * fix, 0))
    return [(nm, float(b), float(s), n) for nm, b, s in zip(names, beta, se) if nm in numeric]
