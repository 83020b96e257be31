import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import inference as I, metrics as M, regression as R, stats


def test_average_precision_and_auc_with_ties(spark):
    s = spark.createDataFrame([("g", 1, 0.9), ("g", 0, 0.8), ("g", 1, 0.7), ("g", 0, 0.6), ("g", 1, 0.5), ("g", 0, 0.1)], "g string, y int, score double")
    assert abs(M.average_precision(s, ["g"]).first()["ap"] - 0.7555555) < 1e-6
    assert abs(M.auc_roc(s, ["g"]).first()["auc"] - 6 / 9) < 1e-12
    tie = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, score double")
    assert M.average_precision(tie, []).first()["ap"] == pytest.approx(1 / 3)
    assert M.auc_roc(tie, []).first()["auc"] == 0.5
    none = spark.createDataFrame([(0, 0.5), (0, 0.4)], "y int, score double")
    assert M.average_precision(none, []).first()["ap"] == 0.0
    w = M.average_precision(s.withColumn("w", F.lit(3)), ["g"], weight="w").first()["ap"]
    assert w == pytest.approx(0.7555555, abs=1e-6)


def diffs(spark, d, key="k"):
    return spark.createDataFrame([(key, i, float(x), 0.0, float(x)) for i, x in enumerate(d)], "k string, seed int, va double, vb double, d double")


def test_wilcoxon_exact_values(spark):
    assert I.wilcoxon(diffs(spark, range(1, 11)), ["k"]).first()["p"] == 2 / 1024
    assert I.wilcoxon(diffs(spark, [0] * 10), ["k"]).first()["p"] == 1.0
    r = I.wilcoxon(diffs(spark, [-1, 2, 3, 4, 5, 6, 7, 8, 9, 10]), ["k"]).first()
    assert (r["w_plus"], r["w_minus"], r["p"]) == (54.0, 1.0, 4 / 1024)


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    t = spark.createDataFrame([("f", str(i), x) for i, x in enumerate(p)], "f string, a string, p double")
    got = [r["p_adj"] for r in I.bh(t, ["f"], ["a"]).orderBy("a").collect()]
    assert np.allclose(got, [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_gates_and_branches(spark):
    one = spark.range(1)
    b = lambda *x: one.select(I.branch(*[F.lit(v) for v in x])).first()[0]
    assert b(0.2, 0.5, 0.19, 0.1, 0.3) == "A" and b(0.4, 0.5, 0.19, -0.1, 0.3) == "B" and b(0.4, 0.5, 0.19, 0.05, 0.1) == "C"
    assert b(0.2, 0.22, 0.19, 0.01, 0.3) == "A"


def test_kappa_and_nmi(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, b int")
    assert stats.confusion(df, [], "a", "b").first()["kappa"] == pytest.approx(0.5)
    same = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "a string, b int")
    assert stats.nmi(same, "a", "b").first()["nmi"] == pytest.approx(1.0)


def test_ols_and_logit_against_numpy(spark):
    r = random.Random(1)
    data = [(r.gauss(0, 1), r.gauss(0, 1), r.randint(0, 5)) for _ in range(300)]
    data = [(a, b, g, 1.0 + 2 * a - b + r.gauss(0, 0.3), float(r.random() < 1 / (1 + np.exp(-(0.3 + a))))) for a, b, g in data]
    df = spark.createDataFrame(data, "a double, b double, g int, t double, y double")
    num = {"a": F.col("a"), "b": F.col("b")}
    x = np.array([[1, d[0], d[1]] for d in data])
    t = np.array([d[3] for d in data])
    beta = np.linalg.lstsq(x, t, rcond=None)[0]
    e = t - x @ beta
    inv = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(u, u) for u in (x[[d[2] == g for d in data]].T @ e[[d[2] == g for d in data]] for g in range(6)))
    se = np.sqrt(np.diag(inv @ meat @ inv) * (6 / 5) * (299 / 297))
    got = {n: (c, s) for n, c, s, _ in R.ols(df, "t", num, (), "g")}
    assert np.allclose([got["a"][0], got["b"][0]], beta[1:]) and np.allclose([got["a"][1], got["b"][1]], se[1:])
    y = np.array([d[4] for d in data])
    w = np.zeros(3)
    for _ in range(25):
        mu = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
    lg = {n: c for n, c, _, _ in R.logit(df, "y", num)}
    assert np.allclose([lg["a"], lg["b"]], w[1:], atol=1e-6)
