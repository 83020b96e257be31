"""Splits, samples, permutations and placebo draws by keyed hash.

A draw depends on (seed, salt, key) only, so it is the same on any number of partitions and after
any retry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cohortry.functions.columns import hash_int, keyed_md5
from cohortry.functions.digests import LONGEST, md5_of, md5_words
from cohortry.operators.ordering import attach, bucket_digits, cumulate, hash_rank, quantiles


def split_temporal(rows: DataFrame, group: Sequence[str], q=(0.6, 0.8), time: str = "t0") -> DataFrame:
    """Older cohorts train, middle validate, most recent test; cut-offs are truncated quantiles."""
    cuts = quantiles(rows, group, time, {"q1": q[0], "q2": q[1]}).select(
        *group, F.col("q1").cast("int").alias("q1"), F.col("q2").cast("int").alias("q2"))
    fold = (F.when(F.col(time) <= F.col("q1"), "train").when(F.col(time) <= F.col("q2"), "val").otherwise("test"))
    return attach(rows, cuts, list(group)).withColumn("split", fold).drop("q1", "q2")


def split_group_disjoint(rows: DataFrame, group: Sequence[str], member: str, seed: int = 0,
                         frac=(0.6, 0.2)) -> DataFrame:
    """All rows of one member land in one fold; members are cut 60/20/20 in hash order."""
    members = rows.select(*group, member).distinct().withColumn("_h", keyed_md5(seed, "disjoint", F.col(member)))
    ranked = hash_rank(members, group, "_h", [member], "_rn", size="_n")
    c1 = F.floor(F.lit(frac[0]) * F.col("_n"))
    c2 = F.floor(F.lit(frac[0] + frac[1]) * F.col("_n"))
    fold = F.when(F.col("_rn") <= c1, "train").when(F.col("_rn") <= c2, "val").otherwise("test")
    return rows.join(ranked.select(*group, member, fold.alias("split")), [*group, member])


def permute(rows: DataFrame, cell: Sequence[str], key: str, value: str, seed: int, out: str,
            salt: str = "permute") -> DataFrame:
    """Exact permutation of ``value`` inside each cell: place i takes the value at place i of another order."""
    takes = hash_rank(rows.withColumn("_h", keyed_md5(seed, salt, "to", F.col(key))), cell, "_h", [key], "_rn")
    gives = hash_rank(rows.select(*cell, key, F.col(value).alias(out), keyed_md5(seed, salt, "from", F.col(key)).alias("_h")),
                      cell, "_h", [key], "_rn").select(*cell, "_rn", out)
    return takes.drop("_h").join(gives, [*cell, "_rn"]).drop("_rn")


def permute_seeds(rows: DataFrame, cell: Sequence[str], key: str, value: str, seeds: int, out: str, salt: str = "permute") -> DataFrame:
    """The same permutation for many seeds in one job (adds ``seed``)."""
    many = _sized(rows, cell).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    c = ["seed", *cell]
    takes = hash_rank(many.withColumn("_h", keyed_md5(F.col("seed"), salt, "to", F.col(key))), c, "_h", [key], "_rn", "_digits")
    gives = hash_rank(many.select(*c, "_digits", key, F.col(value).alias(out), keyed_md5(F.col("seed"), salt, "from", F.col(key)).alias("_h")),
                      c, "_h", [key], "_rn", "_digits").select(*c, "_rn", out)
    return takes.drop("_h").join(gives.hint("merge"), [*c, "_rn"]).drop("_rn")


def _sized(rows: DataFrame, cell: Sequence[str]) -> DataFrame:
    """``rows`` with the digits that suit the size of their cell, counted once before seeds or draws repeat them."""
    n = rows.groupBy(*cell).agg(bucket_digits(F.count(F.lit(1))).alias("_digits"))
    return attach(rows, n, list(cell))


def sample_rows(rows: DataFrame, stratum: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows per stratum without replacement, in hash order (map-side limited before the shuffle)."""
    h = rows.withColumn("_h", keyed_md5(seed, "sample", F.col(key)))
    w = W.partitionBy(*stratum) if stratum else W.partitionBy(F.lit(0))
    return (h.withColumn("draw_rank", F.row_number().over(w.orderBy("_h", key)))
            .where(F.col("draw_rank") <= n).drop("_h"))


def block_offsets(blocks: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, n: str,
                  out: str = "off", total: str = "pool") -> DataFrame:
    """Start of each block when the blocks of a group are laid end to end in ``order``.

    ``bucket`` must follow the order (a prefix of its first column); it splits a group with many
    blocks over tasks.
    """
    b = blocks.withColumn("_b", bucket)
    per = b.groupBy(*group, "_b").agg(F.sum(n).alias("_s"))
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*group, "_b", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_o"),
                     F.sum("_s").over(W.partitionBy(*group)).alias(total))
    local = W.partitionBy(*group, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inner = b.withColumn("_l", F.coalesce(F.sum(n).over(local), F.lit(0)))
    return (inner.join(per, [*group, "_b"]).withColumn(out, (F.col("_l") + F.col("_o")).cast("bigint")).drop("_b", "_l", "_o"))


def placebo_draw(rows: DataFrame, group: Sequence[str], key: str, member: str, time: str, band: int | None,
                 seeds: int, salt: str = "placebo", fallback: bool = True) -> DataFrame:
    """One row of another member per (row, seed), uniform over the rows within +-band periods.

    The pool of a period lays its rows end to end, all rows of a member side by side. A draw picks a
    number below (pool size - own block) and steps over the own block, so it is uniform without a
    retry and no pair is ever listed: the work is rows x (2*band+1) places plus rows x seeds draws.
    Rows whose band holds no other member draw from the whole group; a group of one member has no
    draw at all. Returns (group, key, seed, donor).
    """
    g = list(group)
    base = rows.select(*g, key, member, time).withColumn("_m", F.md5(F.col(member).cast("string")))
    drawn = _draw_in_pool(base, g, key, member, time, band, seeds, salt)
    if band is None or not fallback:
        return drawn
    cell = base.groupBy(*g, time, member).agg(F.count(F.lit(1)).alias("n"))
    spread = cell.select(*g, F.explode(F.sequence(F.col(time) - band, F.col(time) + band)).alias(time), member, "n")
    pool = spread.groupBy(*g, time).agg(F.sum("n").alias("pool"))
    own = spread.groupBy(*g, time, member).agg(F.sum("n").alias("own"))
    stuck_cells = own.join(pool, [*g, time]).where(F.col("own") == F.col("pool")).select(*g, time, member)
    stuck = base.join(stuck_cells, [*g, time, member], "left_semi")
    return drawn.unionByName(_draw_in_pool(base, g, key, member, time, None, seeds, salt, askers=stuck))


def _draw_in_pool(base, g, key, member, time, band, seeds, salt, askers=None):
    ranked = hash_rank(base.withColumn("_h", F.md5(F.col(key).cast("string"))), [*g, member, time], "_h", [key], "_rk")
    cells = base.groupBy(*g, member, "_m", time).agg(F.count(F.lit(1)).alias("n"))
    if band is None:
        at = cells.withColumn("_at", F.lit(0))
        anchor = F.lit(0)
    else:
        wanted = base.select(*g, F.col(time).alias("_at")).distinct()
        at = cells.withColumn("_at", F.explode(F.sequence(F.col(time) - band, F.col(time) + band))).join(wanted, [*g, "_at"], "left_semi")
        anchor = F.col(time)
    off = block_offsets(at, [*g, "_at"], ["_m", member, time], F.substring("_m", 1, 2), "n")
    own = off.groupBy(*g, "_at", member).agg(F.min("off").alias("_own_off"), F.sum("n").alias("_own_n"), F.max("pool").alias("_pool"))
    places = ranked.join(off.select(*g, "_at", member, time, "off"), [*g, member, time]).select(
        *g, "_at", (F.col("off") + F.col("_rk") - 1).alias("_pos"), F.col(key).alias("donor"))
    asks = (base if askers is None else askers).withColumn("_at", anchor).join(own, [*g, "_at", member])
    asks = asks.where(F.col("_pool") > F.col("_own_n")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    k = F.pmod(hash_int(keyed_md5(F.col("seed"), salt, F.col(key))), F.col("_pool") - F.col("_own_n"))
    asks = asks.withColumn("_k", k).withColumn("_pos", F.when(F.col("_k") >= F.col("_own_off"), F.col("_k") + F.col("_own_n")).otherwise(F.col("_k")))
    return asks.select(*g, "_at", "_pos", key, "seed").join(places, [*g, "_at", "_pos"]).select(*g, key, "seed", "donor")


def rolling_origins(rows: DataFrame, group: Sequence[str], time: str, n: int = 4, width: int = 2) -> DataFrame:
    """Test windows of ``width`` periods ending at the latest period; validation is the window before,
    training everything older."""
    hi = rows.groupBy(*group).agg(F.max(time).alias("hi"))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    o = hi.select(*group, "hi", k)
    test_hi = F.col("hi") - F.col("k") * width
    return o.select(*group, (F.lit(n - 1) - F.col("k")).alias("origin"), (test_hi - width + 1).alias("test_lo"), test_hi.alias("test_hi"),
                    (test_hi - 2 * width + 1).alias("val_lo"), (test_hi - width).alias("val_hi"))


def split_rolling(rows: DataFrame, origins: DataFrame, group: Sequence[str], time: str) -> DataFrame:
    """(origin, split) of every row per origin; rows later than the test window leave that origin."""
    j = attach(rows, origins, list(group))
    fold = (F.when(F.col(time) < F.col("val_lo"), "train").when(F.col(time) <= F.col("val_hi"), "val")
            .when(F.col(time) <= F.col("test_hi"), "test"))
    return j.withColumn("split", fold).where(F.col("split").isNotNull())


def bootstrap_weights(rows: DataFrame, group: Sequence[str], key: str, draws: int, salt: str = "boot") -> DataFrame:
    """(group, draw, key, weight): n picks with replacement per draw, as counts.

    Every row stands for one pick slot of each draw and names the row at place ``hash mod n``. The
    weights depend on the key only, so all models and seeds share one resample. It shuffles rows times draws: for many
    draws use ``resample_weights``.
    """
    g = list(group)
    r = hash_rank(rows.select(*g, key).distinct().withColumn("_h", keyed_md5(salt, F.col(key))), g, "_h", [key], "_pos", size="_n")
    slots = r.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.select(*g, "draw", (F.pmod(hash_int(keyed_md5(F.col("draw"), salt, F.col(key))), F.col("_n")) + 1).alias("_pos"))
    return (picks.groupBy(*g, "draw", "_pos").agg(F.count(F.lit(1)).alias("weight"))
            .join(r.select(*g, "_pos", key), [*g, "_pos"]).select(*g, "draw", key, "weight"))


#: Bounds of the Poisson(1) distribution in 32 bits: a draw's weight is the number of them that its key reaches.
POISSON = [round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def resample_weights(key: Column, draws: int, salt: str = "boot") -> Column:
    """Weights of a row in ``draws`` resamples, as an array: independent Poisson(1) counts from the row's key alone.

    In place of n picks with replacement every row says by itself how often it is picked, so no draw has to
    bring rows together; sizes vary around n, and a weighted metric divides by them. One digest serves four
    draws (eight hex digits each). All models and seeds share the resamples.
    """
    digests = F.transform(F.sequence(F.lit(0), F.lit(draws // 4 - 1)), lambda b: keyed_md5(b, salt, key))
    lanes = F.flatten(F.transform(digests, lambda d: F.array(*[F.conv(F.substring(d, i * 8 + 1, 8), 16, 10).cast("bigint") for i in range(4)])))
    return F.transform(lanes, lambda h: sum(((h >= t).cast("int") for t in POISSON[1:]), (h >= POISSON[0]).cast("int")))


def resample_matrix(keys: list, draws: int, salt: str = "boot", first: int = 0) -> np.ndarray:
    """The same weights for a list of keys, a row each, of ``draws`` draws from ``first`` on. All digests of keys of one
    length are made together."""
    texts = [str(k).encode() for k in keys]
    heads = [f"{b}|{salt}|".encode() for b in range(first // 4, (first + draws) // 4)]
    held = np.empty((len(texts), len(heads), 4), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = np.fromiter(map(len, heads), np.int64, len(heads))
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        tail = np.frombuffer(b"".join(texts[i] for i in own), np.uint8).reshape(len(own), n)
        for p in np.unique(wide).tolist():
            at = np.flatnonzero(wide == p)
            if n + p > LONGEST:
                words = md5_of([heads[j] + texts[i] for j in at for i in own])
            else:
                rows = np.empty((len(at), len(own), p + n), np.uint8)
                rows[:, :, :p] = np.frombuffer(b"".join(heads[j] for j in at), np.uint8).reshape(len(at), 1, p)
                rows[:, :, p:] = tail
                words = md5_words(rows.reshape(-1, p + n))
            held[own[:, None], at] = words.reshape(4, len(at), len(own)).T
    h = held.byteswap().reshape(len(texts), draws)
    top = h >> np.uint32(16)
    out = _COUNTS[top]
    near = np.nonzero(out == 255)
    out[near] = np.searchsorted(np.array(POISSON), h[near].astype(np.int64), side="right")
    return out


#: Weights by the upper 16 bits of a number, 255 where a bound lies among the numbers that share them.
_COUNTS = np.searchsorted(np.array(POISSON), np.arange(1 << 16, dtype=np.int64) << 16, side="right").astype(np.uint8)
_COUNTS[[t >> 16 for t in POISSON if t >> 16 < 1 << 16]] = 255


def configuration_null(edges: DataFrame, draws: int = 1) -> DataFrame:
    """Random graphs with the degrees of ``edges`` (src, dst): stubs in hash order are paired two by
    two, loops and repeats dropped. All draws come from one job."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    deg = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    stubs = deg.select("node", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("i")).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    r = hash_rank(stubs.withColumn("_h", keyed_md5(F.col("draw"), "stub", F.col("node"), F.col("i"))), ["draw"], "_h", ["node", "i"], "_rn")
    pair = r.withColumn("_p", F.floor((F.col("_rn") - 1) / 2)).groupBy("draw", "_p").agg(
        F.min("node").alias("src"), F.max("node").alias("dst"), F.count(F.lit(1)).alias("n"))
    return pair.where((F.col("n") == 2) & (F.col("src") != F.col("dst"))).select("draw", "src", "dst").distinct()


def random_assignment_null(rows: DataFrame, key: str, member: str, draws: int = 1) -> DataFrame:
    """Keep every member's size and deal the keys out anew: an exact permutation per draw."""
    r = _sized(rows.select(key, member), []).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    a = hash_rank(r.withColumn("_h", keyed_md5(F.col("draw"), "deal", "to", F.col(key))), ["draw"], "_h", [key], "_rn", "_digits")
    b = hash_rank(r.withColumn("_h", keyed_md5(F.col("draw"), "deal", "from", F.col(key))), ["draw"], "_h", [key], "_rn", "_digits")
    return a.select("draw", "_rn", key).join(b.select("draw", "_rn", member).hint("merge"), ["draw", "_rn"]).select("draw", key, member)


def rate_above(values: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: share of rows strictly above it, at or above it, and its own mass."""
    c = cumulate(values, group, value, {"n": F.lit(1)}, descending=True)
    t = F.col("tot_n")
    return c.select(*group, value, ((F.col("cum_n") - F.col("n")) / t).alias("p_gt"), (F.col("cum_n") / t).alias("p_ge"), (F.col("n") / t).alias("mass"))
