import random

from pyspark.sql import functions as F

from cohortry.operators import graph as G, lineage as L, stats


def test_components_match_union_find(spark):
    r = random.Random(2)
    e = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100, i) for i in range(101, 140)]
    e = [(a, b) for a, b in e if a != b]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}


def test_depth_with_cycle_and_cap(spark):
    par = {1: 2, 2: 3, 3: 1, 10: 1, 20: 21, 40: 40, **{i: i + 1 for i in range(50, 75)}}
    df = spark.createDataFrame(list(par.items()), "pid long, parent long")
    got = {r["pid"]: r["depth"] for r in L.lineage_depth(L.ancestor_paths(df)).collect()}
    for p in par:
        d, seen, cur = 0, set(), p
        while cur in par and cur not in seen and d < 12:
            seen.add(cur)
            cur = par[cur]
            d += 1
        assert got[p] == d, p


def test_walks_follow_edges_and_reach_their_length(spark):
    e = spark.createDataFrame([(i, (i * 7 + 1) % 30) for i in range(30)] + [(0, i) for i in range(10, 29)], "src long, dst long").where("src <> dst")
    ok = {(r["src"], r["dst"]) for r in e.collect()} | {(r["dst"], r["src"]) for r in e.collect()}
    for w in G.random_walks(e, 2, 6).collect():
        assert len(w["path"]) == 6 and all(p in ok for p in zip(w["path"], w["path"][1:]))


def test_pagerank_sums_to_one_and_modularity_of_two_cliques(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (4, 3, 2.0)], "src long, dst long, weight double")
    assert abs(G.pagerank(e, 10).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    tri = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6)]
    lab = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(1, 7)], "node long, community int")
    assert stats.modularity(spark.createDataFrame(tri, "src long, dst long"), lab).first()["q"] == 0.5
    q = stats.modularity(spark.createDataFrame(tri + [(3, 4)], "src long, dst long"), G.communities(spark.createDataFrame(tri + [(3, 4)], "src long, dst long")))
    assert abs(q.first()["q"] - (6 / 7 - 0.5)) < 1e-9  # the two triangles


def test_pagerank_makes_all_rounds_without_a_tolerance(spark):
    """A chain with a way back settles slowly: a stop on the change ends before the last round."""
    e = [(i, i + 1, 1.0) for i in range(12)] + [(i + 1, i, 3.0) for i in range(12)]
    total = {}
    for a, _, w in e:
        total[a] = total.get(a, 0.0) + w
    rank = dict.fromkeys(range(13), 1 / 13)
    for _ in range(30):
        came = dict.fromkeys(rank, 0.0)
        for a, b, w in e:
            came[b] += rank[a] * w / total[a]
        rank = {n: 0.85 * c + 0.15 / 13 for n, c in came.items()}
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    got = {r["node"]: r["rank"] for r in G.pagerank(df, iterations=30, tol=0.0).collect()}
    assert all(abs(got[n] - rank[n]) < 1e-14 for n in rank)
    early = {r["node"]: r["rank"] for r in G.pagerank(df, iterations=30, tol=1e-2).collect()}
    assert any(abs(early[n] - rank[n]) > 1e-6 for n in rank)
