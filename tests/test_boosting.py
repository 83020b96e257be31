import numpy as np
import pytest

from cohortry.operators import boosting as B


def plain(x, y, fit, rounds, depth, rate, least, bins, edges, ridge=1e-6):
    """The same boosting of one model, in memory and node by node."""
    b = B.binned(x, edges)
    f = np.full(len(y), np.log((y[fit].sum() + 0.5) / (fit.sum() - y[fit].sum() + 0.5)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            own = rows[fit[rows]]
            best = (1e-9, None)
            if level < depth:
                whole = g[own].sum() ** 2 / (h[own].sum() + ridge)
                for c in range(x.shape[1]):
                    for cut in range(bins):
                        left = b[own, c] <= cut
                        if left.sum() >= least and (~left).sum() >= least:
                            gain = sum(g[own[s]].sum() ** 2 / (h[own[s]].sum() + ridge) for s in (left, ~left)) - whole
                            if round(gain, 9) > round(best[0], 9):
                                best = (gain, (c, cut))
            if best[1] is None:
                f[rows] += -rate * g[own].sum() / (h[own].sum() + ridge)
                return
            left = b[rows, best[1][0]] <= best[1][1]
            grow(rows[left], level + 1)
            grow(rows[~left], level + 1)
        grow(np.arange(len(y)), 0)
    return 1 / (1 + np.exp(-f))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    out = []
    for g, n in (("a", 260), ("b", 120)):
        x = np.round(rng.normal(size=(n, 3)), 1)
        y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5) ^ (rng.random(n) < 0.1)).astype(float)
        out += [(g, i, float(t), v.tolist(), [bool(i % 5), bool(i % 7)]) for i, (t, v) in enumerate(zip(y, x))]
    return out + [("alike", i, 1.0, [0.0, 1.0, float(i)], [True, True]) for i in range(30)]


def test_many_boosted_models_equal_single_ones(spark, data, monkeypatch):
    monkeypatch.setattr(B, "FRESH", 2)
    rows = spark.createDataFrame(data, "grp string, i int, y double, x array<double>, members array<boolean>").repartition(4)
    model = B.fit_boosted(rows, 3, rounds=5, depth=3, least=10, bins=8)
    got = {(r["grp"], r["i"], r["part"]): r["score"] for r in B.boosted_scores(rows.withColumn("g", rows.grp), model, ["g", "i"], 3).withColumnRenamed("g", "grp").collect()}
    for g in "ab":
        own = [r for r in data if r[0] == g]
        x, y = np.array([r[3] for r in own]), np.array([r[2] for r in own])
        for k in (0, 1):
            want = plain(x, y, np.array([r[4][k] for r in own]), 5, 3, 0.1, 10, 8, model.edges[g])
            assert np.abs(np.array([got[g, r[1], k] for r in own]) - want).max() < 1e-9
    assert not model.trees["alike", 0] and len({got["alike", i, 0] for i in range(30)}) == 1
    staged = B.boosted_scores(rows, model, ["i"], 3, staged=True)
    assert staged.where("part = 0").groupBy("round").count().count() == 6  # five rounds, and 0 for the group without trees


def test_boosting_stops_when_the_watched_loss_does(spark, data):
    rows = spark.createDataFrame(data, "grp string, i int, y double, x array<double>, members array<boolean>")
    model = B.fit_boosted(rows, 3, rounds=60, depth=2, least=10, bins=8, patience=3, rate=0.8)
    for k in (("a", 0), ("b", 1)):
        n = len(model.trees[k])
        assert n < 60 and (len(model.trees[k][-1].child) == 1 or min(model.losses[k][-3:]) >= min(model.losses[k][:-3]) - 1e-7)
