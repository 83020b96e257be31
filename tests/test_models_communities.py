import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.functions.digests import md5_of
from cohortry.operators import draws as D, graph as G, many_models as ML, metrics as M, packed, stats


def logit_by_steps(x, y, c):
    """Plain Newton steps of one penalised logistic model on standardised columns."""
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    pen, b = np.append(np.full(x.shape[1], 1 / c), 0.0), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pen), z.T @ (y - p) - pen * b)
    return b


def test_many_logits_equal_single_fits(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g, n in (("a", 300), ("b", 80), ("one class", 9)):
        x = rng.normal(size=(n, 3)) * [1, 20, 0.01] + [0, 100, 5]
        y = (x[:, 0] + rng.normal(size=n) > 0).astype(float) if g != "one class" else np.ones(n)
        rows += [(g, float(t), v.tolist(), [True, bool(i % 3)]) for i, (t, v) in enumerate(zip(y, x))]
    train = spark.createDataFrame(rows, "grp string, y double, x array<double>, members array<boolean>").repartition(5)
    got = ML.fit_logits(train, 3, 0.5)
    for g, part in itertools.product("ab", (0, 1)):
        own = [r for r in rows if r[0] == g]
        x, y = np.array([r[2] for r in own]), np.array([r[1] for r in own])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        keep = np.array([r[3][part] for r in own])
        b = np.append(np.zeros(3), 0.0)
        zz = np.column_stack([z, np.ones(len(z))])[keep]
        for _ in range(40):
            p = 1 / (1 + np.exp(-zz @ b))
            b = b + np.linalg.solve(zz.T @ (zz * (p * (1 - p))[:, None]) + np.diag([2.0, 2, 2, 0]), zz.T @ (y[keep] - p) - np.array([2.0, 2, 2, 0]) * b)
        assert np.abs(got.betas[g, part] - b).max() < 1e-8
    assert np.abs(got.betas["a", 0] - logit_by_steps(np.array([r[2] for r in rows if r[0] == "a"]), np.array([r[1] for r in rows if r[0] == "a"]), 0.5)).max() < 1e-8
    assert got.betas["one class", 0].tolist()[:3] == [0, 0, 0]
    out = ML.predicted(train, got, ["y"], 3)
    assert out.count() == 2 * len(rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert ML.predicted(train.withColumn("grp", F.lit("unseen")), got, ["y"], 3).count() == 0


def test_resampled_precision_equals_weighting_every_draw(spark):
    rng = np.random.default_rng(3)
    rows = [(f, m, i, int(rng.random() < 0.4), round(float(rng.random()), 2)) for f in ("x", "y") for i in range(150) for m in ("m", "n")] + [("z", "m", 1, 0, 0.5)]
    scores = spark.createDataFrame(rows, "f string, m string, k long, y int, score double")
    draws = 12
    got = {(r["f"], r["m"], r["draw"]): r for r in M.resampled_precision(scores.repartition(6), ["f", "m"], "k", draws).collect()}
    w = {r["k"]: r["w"] for r in scores.select("k", D.resample_weights(F.col("k"), draws).alias("w")).distinct().collect()}
    assert np.array_equal(D.resample_matrix(list(w), draws), np.array(list(w.values())))
    long = scores.join(spark.createDataFrame([(k, d, int(v)) for k, ws in w.items() for d, v in enumerate(ws)], "k long, draw int, w int"), "k").where("w > 0")
    want = M.average_precision(long, ["f", "m", "draw"], weight="w").collect()
    for r in want:
        g = got[r["f"], r["m"], r["draw"]]
        assert g["ap"] == pytest.approx(r["ap"], abs=1e-12) and g["positives"] == r["positives"] and g["rows"] == r["rows"]
    assert len(got) == 5 * draws


def test_groups_that_share_keys_digest_each_key_once(monkeypatch):
    seen = []
    monkeypatch.setattr(M, "resample_matrix", lambda keys, draws, salt="boot", first=0: seen.extend(keys) or D.resample_matrix(keys, draws, salt, first))
    kind = pa.list_(pa.struct([("g", pa.string()), ("y", pa.int64()), ("s", pa.float64())]))
    rows = [[{"g": f"model {m}", "y": int((i + m) % 3 == 0), "s": float(i * m % 7)} for m in range(30)] for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(["u"] * 40), pa.array([1] * 40, pa.int32()), pa.array([str(i) for i in range(40)]), pa.array(rows, kind)], names=["u", "block", "k", "r"])
    out = pa.Table.from_batches(M._cells(300)([batch.slice(0, 25), batch.slice(25)])).to_pydict()
    assert len(seen) == 40 and len(out["g"]) == 30 * 44 and sorted(set(out["draw"])) == list(range(256, 300))


def test_resampled_precision_is_the_same_held_and_streamed(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f, m, i, int(rng.random() < 0.3), round(float(rng.normal()), 1)) for f, n in (("x", 300), ("y", 40)) for i in range(n) for m in ("a", "b", "c")]
    scores = spark.createDataFrame([*rows, ("x", "a", 7, 1, 0.5), ("none", "a", 7, 0, 0.5)], "f string, m string, k long, y int, score double")

    def run():
        return {(r["f"], r["m"], r["draw"]): (r["positives"], r["rows"], r["ap"]) for r in M.resampled_precision(scores, ["f", "m"], "k", 260, share=["f"]).collect()}
    held = run()
    monkeypatch.setattr(M, "CELL", (200, 200))
    mixed = run()
    monkeypatch.setattr(M, "CELL", (0, 0))
    streamed = run()
    assert len(held) == 7 * 260 and held.keys() == mixed.keys() == streamed.keys()
    for k, v in streamed.items():
        assert held[k][:2] == mixed[k][:2] == v[:2] and held[k][2] == pytest.approx(v[2], abs=1e-12) and mixed[k][2] == pytest.approx(v[2], abs=1e-12)


def test_digests_of_arrays_equal_the_library():
    texts = [(b"%d" % (i * 7919))[-1 - i % 9:] * (1 + i % 13) for i in range(900)]
    assert md5_of(texts).T.tobytes() == b"".join(hashlib.md5(x).digest() for x in texts)


def test_resample_weights_are_poisson(spark):
    w = D.resample_matrix(list(range(400)), 200)
    share = np.bincount(w.reshape(-1), minlength=8)[:4] / w.size
    assert np.abs(share - np.array([1, 1, 1 / 2, 1 / 6]) * np.exp(-1)).max() < 0.005 and abs(w.mean() - 1) < 0.02


def ring_of_cliques(cliques, size):
    out = [(c * size + i, c * size + j) for c in range(cliques) for i, j in itertools.combinations(range(size), 2)]
    return out + [(c * size, (c * size + size + 1) % (cliques * size)) for c in range(cliques)]


def modularity(edges, lab):
    deg, inner, m = {}, 0, len(edges)
    for a, b in edges:
        deg[lab[a]] = deg.get(lab[a], 0) + 1
        deg[lab[b]] = deg.get(lab[b], 0) + 1
        inner += lab[a] == lab[b]
    return inner / m - sum((d / 2 / m) ** 2 for d in deg.values())


def test_levels_merge_cliques_and_no_node_gains_by_moving(spark):
    graphs = {0: ring_of_cliques(24, 3), 1: [(i, i + 1) for i in range(60)], 2: ring_of_cliques(5, 6) + [(1000, 1001), (1001, 1002)]}
    e = spark.createDataFrame([(k, a, b) for k, es in graphs.items() for a, b in es], "k int, src long, dst long")
    lab = G.communities(e, ["k"])
    q = {r["k"]: r["q"] for r in stats.modularity(e, lab, ["k"]).collect()}
    found = {k: {r["node"]: r["community"] for r in lab.where(F.col("k") == k).collect()} for k in graphs}
    for k, es in graphs.items():
        nodes = {n for e_ in es for n in e_}
        assert set(found[k]) == nodes and q[k] == pytest.approx(modularity(es, found[k]), abs=1e-9)
    single = {n: n // 3 for n in found[0]}  # a clique each: joining neighbours scores more, which single moves cannot find
    assert q[0] > modularity(graphs[0], single) + 0.01
    assert q[1] > 0.7
    assert len({found[2][i] for i in range(30)}) == 5 and len({found[2][i] for i in (1000, 1001, 1002)}) == 1


def test_communities_of_odd_graphs(spark):
    assert G.communities(spark.createDataFrame([], "src long, dst long")).count() == 0
    two = {r["node"]: r["community"] for r in G.communities(spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")).collect()}
    assert two[1] == two[2] != two[3] == two[4]


def test_a_hub_takes_many_nodes_in_few_rounds(spark):
    """300 arms of two nodes around a hub that gains by 34 of them: one move a round would need as many rounds."""
    arms = [e for i in range(1, 301) for e in ((0, i), (i, 1000 + i))]
    e = spark.createDataFrame(arms, "src long, dst long")
    lab = {r["node"]: r["community"] for r in G.communities(e, coin_rounds=0, most_rounds=15).collect()}
    assert all(lab[i] == lab[1000 + i] for i in range(1, 301)) and 25 < sum(lab[i] == lab[0] for i in range(1, 301)) < 45


def test_safe_moves_gain_together(spark):
    rng = np.random.default_rng(6)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, size=(150, 2)).tolist() if a != b})
    own = {n: n % 9 for n in range(60)}
    deg = {n: float(sum(n in p for p in pairs)) for n in own}
    m2 = sum(deg.values())
    tot = {c: sum(deg[n] for n in own if own[n] == c) for c in range(9)}
    links = {(n, c): sum(own[b if a == n else a] == c for a, b in pairs if n in (a, b)) for n in own for c in range(9)}
    wants = []
    for n in own:
        gain = {c: links[n, c] - deg[n] * (tot[c] - (deg[n] if c == own[n] else 0)) / m2 for c in range(9)}
        best = max(gain, key=lambda c: (gain[c], c))
        if gain[best] - gain[own[n]] > 1e-8:
            wants.append((n, own[n], best, gain[best] - gain[own[n]], deg[n], m2))
    go = {r["node"]: r["to"] for r in G._safe(spark.createDataFrame(wants, "node long, own long, to long, rise double, deg double, m2 double"), []).collect()}
    before, after = modularity(pairs, own), modularity(pairs, own | go)
    assert go and after > before and not {own[n] for n in go} & set(go.values())


def test_step_frequencies_follow_the_weights(spark):
    e = spark.createDataFrame([(0, 1)] * 6 + [(0, 2)] * 3 + [(0, 3)], "src long, dst long")
    w = G.seeded_walks(e, 400, 2, [0, 1]).where("node = 0").select(F.col("path")[1].alias("to")).groupBy("to").count().collect()
    share = {r["to"]: r["count"] / 800 for r in w}
    assert abs(share[1] - 0.6) < 0.06 and abs(share[2] - 0.3) < 0.06 and abs(share[3] - 0.1) < 0.04


def test_factor_vectors_equal_a_truncated_decomposition(spark):
    rng = np.random.default_rng(4)
    m = {s: rng.normal(size=(30, 6)) @ rng.normal(size=(6, 30)) for s in (0, 1)}
    rows = [(s, i, j, float(v)) for s, a in m.items() for (i, j), v in np.ndenumerate(a)]
    got = G.factor_vectors(spark.createDataFrame(rows, "s int, node long, context long, w double").repartition(4), ["s"], 8, 3).collect()
    for s, a in m.items():
        u, d, _ = np.linalg.svd(a)
        v = np.array([r["v"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["node"])])
        assert np.abs(v @ v.T - u[:, :6] @ np.diag(d[:6]) @ u[:, :6].T).max() < 1e-6 * d[0]


def test_walk_vectors_part_two_cliques(spark):
    e = spark.createDataFrame(ring_of_cliques(2, 7), "src long, dst long")
    pairs = G.cooccurrences(G.seeded_walks(e, 10, 20, [0]), ["seed"], 4)
    v = {r["node"]: np.array(r["v"]) for r in G.factor_vectors(G.shifted_ppmi(pairs, ["seed"], 1.0), ["seed"], 4).collect()}

    def cos(a, b):
        return float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    assert min(cos(2, i) for i in range(3, 7)) > max(cos(2, i) for i in range(9, 14))


def test_cooccurrences_equal_counting_every_place(spark):
    rng = np.random.default_rng(5)
    paths = [(i % 3, rng.integers(0, 9, size=int(n)).tolist()) for i, n in enumerate(rng.integers(1, 12, size=60))]
    want = {}
    for s, p in paths:
        for i, j in itertools.permutations(range(len(p)), 2):
            if abs(i - j) <= 4:
                want[s, p[i], p[j]] = want.get((s, p[i], p[j]), 0) + 1
    w = spark.createDataFrame(paths, "seed int, path array<long>").repartition(3)
    pairs = G.cooccurrences(w, ["seed"], 4)
    assert {(r["seed"], r["node"], r["context"]): r["n"] for r in pairs.collect()} == want
    named = G.cooccurrences(w.select("seed", F.transform("path", lambda x: F.concat(F.lit("n"), x)).alias("path")), ["seed"], 4)
    assert {(r["seed"], int(r["node"][1:]), int(r["context"][1:])): r["n"] for r in named.collect()} == want


def test_pairs_are_summed_before_they_leave_a_batch(spark):
    """One batch of equal paths: the aggregate reads a row per unordered pair, not one per place."""
    w = spark.createDataFrame([(0, [1, 2, 3, 4])] * 500, "seed int, path array<long>").coalesce(1)
    pairs = G.cooccurrences(w, ["seed"], 2)
    assert {r["n"] for r in pairs.collect()} == {500}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and pairs.count() == 10


def odd_graph(spark):
    r = np.random.default_rng(2)
    return spark.createDataFrame([(0, int(i)) for i in range(1, 40)] + [(int(a), int(b)) for a, b in r.integers(1, 60, size=(90, 2)) if a != b] + [(3, None), (70, 71)], "src long, dst long")


def test_walks_are_the_same_with_a_held_graph_and_by_joins(spark, monkeypatch):
    def run():
        return sorted((r["seed"], r["node"], r["walk"], tuple(r["path"])) for r in G.seeded_walks(odd_graph(spark), 3, 12, [0, 4]).collect())
    held = run()
    monkeypatch.setattr(packed, "PLACES", 0)
    assert held == run() and len(held) > 100


def test_held_walks_join_no_step(spark):
    plan = G.seeded_walks(odd_graph(spark), 2, 30, [0])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan


def test_packed_vectors_equal_those_of_rows(spark):
    w = G.seeded_walks(odd_graph(spark).where("dst is not null"), 5, 20, [0, 1])
    rows, whole, parts = (G.cooccurrences(w, ["seed"], 3, form) for form in ("rows", "packed", "parts"))
    assert whole.count() == whole.select("seed", "node").distinct().count()
    assert {(r["seed"], r["node"], c): n for r in whole.collect() for c, n in zip(r["contexts"], r["counts"])} == {(r["seed"], r["node"], r["context"]): r["n"] for r in rows.collect()}

    def vectors(df):
        return {(r["seed"], r["node"]): np.array(r["v"]) for r in df.collect()}
    want, got = vectors(G.projected_vectors(rows, ["seed"], 70)), vectors(G.projected_vectors(parts, ["seed"], 70))
    assert want.keys() == got.keys() and all(np.array_equal(want[k], got[k]) for k in want)
    want, got = (vectors(G.factor_vectors(G.shifted_ppmi(p, ["seed"], 1.0), ["seed"], 6)) for p in (rows, whole))
    assert want.keys() == got.keys() and max(np.abs(want[k] - got[k]).max() for k in want) < 1e-6
    plan = G.projected_vectors(parts, ["seed"], 8)._jdf.queryExecution().executedPlan().toString()
    assert "context" not in plan.split("Exchange")[1].split("MapInArrow")[0]  # no pair is shuffled


def test_pairs_of_a_full_task_are_counted_in_parts(spark, monkeypatch):
    w = pa.RecordBatch.from_pydict({"path": [[1, 2, 3, 1]] * 50})
    out = list(packed._counted(w, 0, [w.column(0).flatten()], [np.full(50, 4)], 2))
    assert {(n, c): k for b in out for n, cs, ks in zip(*[x.to_pylist() for x in b.columns]) for c, k in zip(cs, ks)} == {(1, 2): 100, (1, 3): 100, (2, 1): 100, (2, 3): 50, (3, 1): 100, (3, 2): 50}
    monkeypatch.setattr(packed, "BLOCK", 7)
    again = list(packed._counted(w, 0, [w.column(0).flatten()], [np.full(50, 4)], 2))
    assert len(again) > 20 and sum(sum(map(sum, b.column(2).to_pylist())) for b in again) == 500
