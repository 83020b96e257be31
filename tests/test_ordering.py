"""The two-level kernels against plain Python on skewed groups (one group holds most rows)."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators.draws import permute_seeds, random_assignment_null
from cohortry.operators.ordering import average_ranks, bucket_digits, cumulate, first_by, hash_rank, quantiles, top_k


def skewed(spark, n=400):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.8 else r.choice("ab"), i, float(r.randint(0, 30))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "g string, id long, v double")


def test_hash_rank_is_the_plain_rank(spark):
    rows, df = skewed(spark)
    got = hash_rank(df.withColumn("h", F.md5(F.col("id").cast("string"))), ["g"], "h", ["id"], size="n").collect()
    import hashlib
    for g in ("hot", "a", "b"):
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for x, i, _ in rows if x == g)
        want = {i: k + 1 for k, (_, i) in enumerate(ids)}
        mine = {r["id"]: r["rn"] for r in got if r["g"] == g}
        assert mine == want
        assert {r["n"] for r in got if r["g"] == g} == {len(ids)}


def test_quantiles_match_numpy(spark):
    rows, df = skewed(spark)
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.975}).collect()}
    for g in got:
        v = [x for k, _, x in rows if k == g]
        assert np.allclose([got[g]["a"], got[g]["m"], got[g]["z"]], np.quantile(v, [0.1, 0.5, 0.975]))
    whole = quantiles(df, [], "v", {"m": 0.3}).first()["m"]
    assert np.isclose(whole, np.quantile([x for _, _, x in rows], 0.3))


def test_cumulate_and_ranks(spark):
    rows, df = skewed(spark)
    c = cumulate(df, ["g"], "v", {"n": F.lit(1)}).collect()
    for r in c:
        assert r["cum_n"] == sum(1 for g, _, v in rows if g == r["g"] and v >= r["v"])
    for r in average_ranks(df, ["g"], "v", "rk").collect():
        peers = [v for g, _, v in rows if g == r["g"]]
        assert r["rk"] == sum(v < r["v"] for v in peers) + (sum(v == r["v"] for v in peers) + 1) / 2


def test_first_by_and_top_k(spark):
    rows, df = skewed(spark)
    f = {r["g"]: r["id"] for r in first_by(df, ["g"], [-F.col("v"), F.col("id")], ["id"]).collect()}
    for g in f:
        assert f[g] == min((-v, i) for x, i, v in rows if x == g)[1]
    big = top_k(df, ["g"], [F.col("v").desc(), F.col("id")], 1500).groupBy("g").count().collect()
    assert sum(r["count"] for r in big) == len(rows)
    small = top_k(df, ["g"], [F.col("v").desc(), F.col("id")], 3)
    assert small.count() == 9
    assert "WindowGroupLimit" in small._jdf.queryExecution().executedPlan().toString()


def test_hash_rank_with_digits_by_group_is_never_broadcast(spark):
    df = spark.range(9000).selectExpr("CASE WHEN id < 8000 THEN 'large' WHEN id < 8990 THEN 'mid' ELSE concat('s', id) END AS g", "id").withColumn("h", F.md5(F.col("id").cast("string")))
    n = df.groupBy("g").agg(bucket_digits(F.count(F.lit(1))).alias("d"))
    ranked = hash_rank(df.join(n, "g"), ["g"], "h", ["id"], hex_digits="d")
    got = {r["id"]: r["rn"] for r in ranked.collect()}
    want = {r["id"]: r["rn"] for r in df.selectExpr("id", "row_number() over (partition by g order by h, id) AS rn").collect()}
    assert got == want and "d" not in ranked.columns
    plain = hash_rank(df, ["g"], "h", ["id"])
    assert "Broadcast" not in plain._jdf.queryExecution().executedPlan().toString()


def test_permutations_keep_their_draws(spark):
    rows = spark.range(5000).selectExpr("id AS subject", "id % 7 AS source", "id % 3 AS cell")
    deal = {(r["draw"], r["subject"]): r["source"] for r in random_assignment_null(rows, "subject", "source", 2).collect()}
    moved = {(r["seed"], r["subject"]): r["moved"] for r in permute_seeds(rows, ["cell"], "subject", "source", 2, "moved").collect()}
    assert len(deal) == len(moved) == 10000
    data = [(r["subject"], r["source"], r["cell"]) for r in rows.collect()]
    for d in range(2):
        def order(side, salt, some):
            return sorted(some, key=lambda r: (hashlib.md5(f"{d}|{salt}|{side}|{r[0]}".encode()).hexdigest(), r[0]))
        for a, b in zip(order("to", "deal", data), order("from", "deal", data)):
            assert deal[d, a[0]] == b[1]
        for c in range(3):
            some = [r for r in data if r[2] == c]
            for a, b in zip(order("to", "permute", some), order("from", "permute", some)):
                assert moved[d, a[0]] == b[1]
