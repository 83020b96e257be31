import numpy as np
import pytest
from pyspark.sql import Row

from cohortry.llm import negatives, queries, whitening
from cohortry.llm.common import F, T

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("key", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=None if v is None else [None if c is None else float(c) for c in v], label=y, x="user's", key="user's") for i, v, y in rows], ROWS)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    a = (rng.normal(size=(700, 6)) @ rng.normal(size=(6, 6)) * 0.2).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    odd = [(900, None, 1), (901, [0.1, None, 0, 0, 0, 0], 1), (902, [nan] * 6, 1), (903, [inf, 0, 0, 0, 0, 0], 2), (None, a[0], 1), (904, a[1], None), (905, a[2], 2), (905, a[2], 2), (700, a[2], 3)]
    return [(i, v, i % 4) for i, v in enumerate(a)] + odd


def whole(v):
    return np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)


def test_whitening_equals_the_plain_decomposition(spark, vectors):
    good = [(i, whole(v)) for i, v, _ in vectors if v is not None and None not in v and np.isfinite(v).all()]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    values, turn = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, turn = values[::-1], turn[:, ::-1]
    got = whitening.whiten(table(spark, vectors).repartition(5)).collect()
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    want = {}
    for i, x in good:
        want.setdefault(i, []).append((int(((n * x - s) ** 2).sum()), (x - s / n) @ turn / np.sqrt(np.maximum(values, 1e-300))))
    sign = {}
    for r in got:
        k = r.component - 1
        deviation, w = next(o for o in want[r.vec_id] if o[0] == r.deviation)
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
        if abs(w[k]) > 1e-6:
            assert sign.setdefault(k, np.sign(w[k] * r.whitened)) == np.sign(w[k] * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(w[k]), abs=1e-8)


def test_rank_one_updates_row_by_row_and_spectra_combined():
    rng = np.random.default_rng(1)
    for rows in (rng.normal(size=(90, 7)), rng.integers(-2, 3, (80, 3)) @ rng.integers(-2, 3, (3, 9)).astype(float), np.ones((5, 4)), np.repeat(rng.normal(size=(4, 5)), 20, axis=0), 1e8 * rng.normal(size=(60, 5)) + 1e9):
        one, two = whitening.Spectrum.empty(rows.shape[1]), whitening.Spectrum.empty(rows.shape[1])
        for r in rows[: len(rows) // 2]:
            one.add_rows(r[None])
        two.add_rows(rows[len(rows) // 2:])
        one.add(whitening.Spectrum.unpacked(two.packed()))
        scatter = np.cov(rows.T, bias=True) * len(rows)
        size = max(np.abs(scatter).max(), 1e-9)
        assert one.n == len(rows) and np.allclose(one.mean, rows.mean(axis=0), rtol=1e-12)
        assert np.abs(one.vectors @ np.diag(one.values) @ one.vectors.T - scatter).max() < 1e-11 * size
        assert np.abs(one.vectors.T @ one.vectors - np.eye(len(one.mean))).max() < 1e-12


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, [(1, None, 1)])).count() == 0
    same = whitening.whiten(table(spark, [(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, 0.0)] * 4  # no variance at all
    ragged = whitening.whiten(table(spark, [(1, [1.0], 1), (2, [0.0, 1.0], 1), (3, [], 1)])).collect()
    assert {r.n for r in ragged} == {3} and len(ragged) == 6
    large = whitening.whiten(table(spark, [(1, [1e30, 0.0], 1), (2, [0.0, 1.0], 1)])).collect()
    assert {r.deviation for r in large} == {None}


def brute(rows, low=80, positives=5, negatives=5):
    rows = sorted({(i, y, tuple(whole(v))) for i, v, y in rows if i is not None and y is not None and v is not None and None not in v and np.isfinite(v).all()})
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted((-int(np.dot(a[2], r[2])), r[0], r[1]) for r in rows if r != a)
        for s, p, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fits = [x for x in scored if x[2] != a[1] and low * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a[0], p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits[:negatives])]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch):
    rows = table(spark, vectors).select("vec_id", "label", whitening.scaled().alias("x"), F.lit(1).alias("norm"))
    want = brute(vectors)
    assert want and sorted(map(tuple, negatives.mine(rows, F.col("vec_id") % 100 == 0).collect())) == want
    monkeypatch.setattr(negatives, "TILE", 100)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    assert sorted(map(tuple, negatives.mine(rows.repartition(3), F.col("vec_id") % 100 == 0).collect())) == want


def test_hard_negatives_of_odd_tables(spark):
    def mined(rows):
        return sorted(map(tuple, negatives.mine(table(spark, rows).select("vec_id", "label", whitening.scaled().alias("x")), F.col("vec_id") % 100 == 0).collect()))
    assert mined([]) == [] and mined([(0, None, 1)]) == [] and mined([(0, [1.0], 1)]) == []
    ties = [(0, [1.0, 0.0], 1)] + [(i, [0.5, 0.0], i % 2) for i in range(1, 30)]
    assert mined(ties) == brute(ties) and len(mined(ties)) == 25
    below = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2), (3, [0.0], 1), (4, [0.0], 2)]
    assert mined(below) == brute(below)


def test_index_leaves_out_dimensions_and_loses_no_pair():
    rng = np.random.default_rng(5)
    x, a = rng.integers(-90, 90, (400, 24)), rng.integers(-90, 90, (9, 24))
    t = np.full(9, 20_000)
    index = negatives.Index(np.arange(400), np.arange(400), np.zeros(400), x, float(negatives.suffix_norms(a)[:, 0].max()), 20_000.0)
    assert (index.stop < 24).any()
    r, c, s = index.above(a, np.zeros(9), np.full(9, -1), t, True)
    full = x[:, None, :] * a[None]
    want = {(i, j): int(v) for (i, j), v in np.ndenumerate(full.sum(axis=2)) if v >= 20_000}
    assert {(int(index.keys[i]), int(j)): int(v) for i, j, v in zip(r, c, s)} == want


@pytest.mark.parametrize("name", ["op11_whitening_secular", "op12_hard_negatives_l2ap"])
def test_queries_take_their_whole_table(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0
