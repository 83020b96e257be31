"""Linear peer and draw operators against brute force with a hub source."""

import random
from collections import Counter

from pyspark.sql import functions as F

from cohortry.operators import draws as D, peers


def rows(n=120, seed=5):
    r = random.Random(seed)
    return [("f", i, 1 if r.random() < 0.7 else r.randint(2, 6), r.randint(0, 25), round(r.random(), 4), r.randint(1, 9), r.randint(1, 9), r.randint(0, 1)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "field string, subject long, source long, t0 int, early_overlap double, early_prod int, early_breadth int, y int")


def test_peer_aggregates(spark):
    data = rows()
    for g in peers.peer_aggregates(frame(spark, data)).collect():
        prior = [d for d in data if d[2] == g["source"] and d[1] != g["subject"] and d[3] <= g["t0"]]
        closed = [d for d in data if d[2] == g["source"] and d[3] + 15 <= g["t0"] + 5]
        assert g["peer_n_prior"] == len(prior) and g["peer_n_closed"] == len(closed)
        mean = sum(d[4] for d in prior) / len(prior) if prior else -1.0
        assert abs(g["peer_overlap_mean"] - mean) < 1e-9
        assert abs(g["peer_track_record"] - (sum(d[7] for d in closed) / len(closed) if closed else -1.0)) < 1e-9


def test_sibling_blocks_stand_for_all_edges(spark):
    data = rows()
    b = peers.sibling_blocks(frame(spark, data)).collect()
    want = sum(1 for i in data for j in data if i[2] == j[2] and i[1] != j[1] and j[3] <= i[3])
    assert sum(r["n_edges"] for r in b) == want


def test_placebo_draw_is_in_band_from_another_source_and_spread(spark):
    data = rows()
    info = {d[1]: d for d in data}
    got = D.placebo_draw(frame(spark, data), ["field"], "subject", "source", "t0", 3, 40).collect()
    assert len(got) == len(data) * 40 and len({(r["subject"], r["seed"]) for r in got}) == len(got)
    for r in got:
        a, b = info[r["subject"]], info[r["donor"]]
        pool = [d for d in data if d[2] != a[2] and abs(d[3] - a[3]) <= 3]
        assert b[2] != a[2]
        assert abs(b[3] - a[3]) <= 3 or not pool
    one = data[0]
    pool = {d[1] for d in data if d[2] != one[2] and abs(d[3] - one[3]) <= 3}
    assert len({r["donor"] for r in got if r["subject"] == one[1]}) > len(pool) / 2


def test_placebo_fallback_and_single_member_group(spark):
    data = [("f", 1, 1, 0, 0.1, 1, 1, 0), ("f", 2, 1, 0, 0.1, 1, 1, 0), ("f", 3, 2, 20, 0.1, 1, 1, 0), ("g", 4, 9, 0, 0.1, 1, 1, 0)]
    got = {(r["subject"], r["donor"]) for r in D.placebo_draw(frame(spark, data), ["field"], "subject", "source", "t0", 3, 3).collect()}
    assert {g for g in got if g[0] in (1, 2)} == {(1, 3), (2, 3)}
    assert {g[1] for g in got if g[0] == 3} <= {1, 2}
    assert not [g for g in got if g[0] == 4]


def test_permutation_and_bootstrap(spark):
    data = rows()
    p = D.permute(frame(spark, data), ["source"], "subject", "y", 1, "y2").collect()
    for s in {d[2] for d in data}:
        assert Counter(r["y2"] for r in p if r["source"] == s) == Counter(d[7] for d in data if d[2] == s)
    w = D.bootstrap_weights(frame(spark, data), ["field"], "subject", 8).groupBy("draw").agg(F.sum("weight").alias("s")).collect()
    assert [r["s"] for r in w] == [len(data)] * 8
    a = D.permute(frame(spark, data), ["source"], "subject", "y", 1, "y2").select("subject", "y2")
    b = D.permute(frame(spark, data).repartition(11), ["source"], "subject", "y", 1, "y2").select("subject", "y2")
    assert a.exceptAll(b).count() == 0


def test_null_graphs_keep_degrees(spark):
    e = spark.createDataFrame([("c%d" % i, "s%d" % (i % 4)) for i in range(40)], "src string, dst string")
    n = D.configuration_null(e, 2)
    assert n.where("src = dst").count() == 0
    assert n.groupBy("draw").count().where("count > 40").count() == 0
    deal = D.random_assignment_null(e, "src", "dst", 2).groupBy("draw", "dst").count().collect()
    assert {r["count"] for r in deal} == {10}
