"""Graph operators on edge tables: weights, typed relations, components, walks, ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from cohortry.functions.columns import hash_int, keyed_md5
from cohortry.operators import packed
from cohortry.operators.ordering import attach, hash_rank
from cohortry.session import materialise


def fragmentation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes, edges, components, share of the largest, and the forest test."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("sz"))
    a = sizes.agg(F.sum("sz").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("sz").alias("lcc_size"))
    j = attach(a, edges.agg(F.count(F.lit(1)).alias("edges")), [])
    return j.select("nodes", "edges", "components", "lcc_size", F.round(F.col("lcc_size").cast("double") / F.col("nodes"), 6).alias("lcc_coverage"),
                    (F.col("edges") < F.col("nodes")).alias("is_forest"))


def weighted_edges(rows: DataFrame) -> DataFrame:
    """(src, dst, weight): 1/fan-out advising, +0.5 both ways for joint events, +0.3 for each reference
    direction; equal (src, dst) add up and loops are dropped.

    ``rows`` has source, subject, interacted, subject_refers, source_refers.
    """
    fan = rows.groupBy("source").agg(F.count_distinct("subject").alias("_n"))
    r = rows.join(fan, "source").where(F.col("source") != F.col("subject"))
    down, up = (F.col("source"), F.col("subject")), (F.col("subject"), F.col("source"))

    def edge(ends, w):
        return F.struct(ends[0].alias("src"), ends[1].alias("dst"), w.cast("double").alias("w"))
    z = F.lit(0.0)
    e = F.array(edge(down, 1.0 / F.col("_n")), edge(down, F.when(F.col("interacted"), 0.5).otherwise(z)), edge(up, F.when(F.col("interacted"), 0.5).otherwise(z)),
                edge(up, F.when(F.col("subject_refers"), 0.3).otherwise(z)), edge(down, F.when(F.col("source_refers"), 0.3).otherwise(z)))
    return r.select(F.explode(e).alias("e")).select("e.*").where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def pagerank(edges: DataFrame, iterations: int = 100, alpha: float = 0.85, tol: float = 1e-6) -> DataFrame:
    """Weighted rank with the mass of sinks spread evenly. Each round reads the ranks three times
    (along edges, at sinks, as they were), so it is written to the shared folder: a round then costs
    one pass and no round before it. Stops when the total change is below n * tol; with ``tol`` 0 all
    ``iterations`` are made."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("_t"))
    share = materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_t")).alias("share")), "share")
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes = materialise(names.join(out.select(F.col("src").alias("node"), F.lit(False).alias("_has")), "node", "left").select("node", F.coalesce("_has", F.lit(True)).alias("sink")), "nodes")
    n = nodes.count()
    rank = nodes.select("node", "sink", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        came = rank.join(share, rank.node == share.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        lost = rank.agg(F.sum(F.when(F.col("sink"), F.col("rank")).otherwise(0.0)).alias("lost"))
        rank = (attach(rank.join(came, rank.node == came.dst, "left").select("node", "sink", F.col("rank").alias("before"), "came"), lost, [])
                .select("before", "node", "sink", (F.lit(alpha) * (F.coalesce("came", F.lit(0.0)) + F.col("lost") / n) + F.lit((1 - alpha) / n)).alias("rank")))
        rank = materialise(rank, f"rank{i}")
        if tol and rank.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < n * tol:
            break
    return rank.select("node", "rank")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating star contractions (each node joins the smallest neighbour,
    first from larger nodes, then from smaller ones). Rounds grow with the logarithm of the graph.

    A hub's neighbours are never gathered: a round is one min-aggregate and one join. Returns
    (node, component), the component being its smallest node.
    """
    names = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    e = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")

    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]
    before = state(e)
    for i in range(max_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
                 .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        e = materialise(small, f"stars{i}")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return names.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def communities(edges: DataFrame, keys: Sequence[str] = (), coin_rounds: int = 8, most_rounds: int = 500) -> DataFrame:
    """(keys, node, community, m2): communities by multi-level modularity search. Nodes move between
    communities until none gains, each community becomes one weighted node (its inner links a loop), and the
    search goes on there, until a level merges nothing. A node with one neighbour begins in its community: it gains there,
    whatever else the community holds. A component whose parts score less than the whole is
    taken whole in the end. ``keys`` run many graphs, such as seeds or null draws, in one job per round;
    graphs that have settled leave it. Not claimed equal to any sequential method."""
    k = list(keys)
    pairs = edges.select(*k, "src", "dst").union(edges.select(*k, "dst", "src"))
    graph = materialise(pairs.groupBy(*k, "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")), "level0")
    total = materialise(graph.groupBy(*k).agg(F.sum("w").alias("m2")), "total")
    member = materialise(_folded_leaves(graph, k), "member")
    graph = materialise(_contracted(graph, member, k), "folded")
    for level in range(1, 64):
        lab = materialise(_moved(graph, total, k, level, coin_rounds if level == 1 else 0, most_rounds), "moved")
        n = lab.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct(F.struct(*k, "community")).alias("groups")).first()
        if n["nodes"] == n["groups"]:
            break
        up = lab.select(*k, F.col("node").alias("community"), F.col("community").alias("_up"))
        member = materialise(member.join(up, [*k, "community"]).select(*k, "node", F.col("_up").alias("community")), "member")
        graph = materialise(_contracted(graph, lab, k), f"level{level}")
    else:
        raise RuntimeError("communities did not settle")
    return attach(_wholes(member, graph, total, k), total, k).select(*k, "node", "community", "m2")


def _folded_leaves(graph: DataFrame, k: list[str]) -> DataFrame:
    """(keys, node, community): a node with one neighbour and no loop is with that neighbour, of two such the larger is
    with the smaller; all others are alone."""
    ends = graph.groupBy(*k, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("only")).withColumn("leaf", (F.col("n") == 1) & (F.col("only") != F.col("node")))
    leaves = ends.where("leaf").select(*k, F.col("node").alias("only"), F.col("leaf").alias("pair"))
    j = ends.withColumn("only", F.when(F.col("leaf"), F.col("only"))).join(leaves, [*k, "only"], "left")
    fold = F.col("leaf") & (F.col("pair").isNull() | (F.col("node") > F.col("only")))
    return j.select(*k, "node", F.when(fold, F.col("only")).otherwise(F.col("node")).alias("community"))


def _contracted(graph: DataFrame, lab: DataFrame, k: list[str]) -> DataFrame:
    """``graph`` with the communities of ``lab`` as nodes; inner links become loops."""
    ends = graph.join(lab.select(*k, F.col("node").alias("src"), F.col("community").alias("_s")), [*k, "src"]).join(lab.select(*k, F.col("node").alias("dst"), F.col("community").alias("_d")), [*k, "dst"])
    return ends.groupBy(*k, F.col("_s").alias("src"), F.col("_d").alias("dst")).agg(F.sum("w").alias("w"))


def _moved(graph: DataFrame, total: DataFrame, k: list[str], level: int, coin_rounds: int, most_rounds: int) -> DataFrame:
    """(keys, node, community) once no node of ``graph`` gains by moving. In the first ``coin_rounds`` a keyed coin
    lets half of the nodes that gain move. Then all moves of ``_safe`` are made at once: the modularity rises, so the rounds come to an
    end, and a hub that many nodes want to join takes them in a few rounds."""
    deg = graph.groupBy(*k, F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    lab = materialise(attach(deg, total, k).withColumn("community", F.col("node")), "labels")
    near_by = graph.where("src <> dst")
    done = []
    for i in range(most_rounds):
        at = lab.join(lab.groupBy(*k, "community").agg(F.sum("deg").alias("tot")), [*k, "community"])
        links = near_by.join(at.select(*k, F.col("node").alias("dst"), "community", "tot"), [*k, "dst"]).groupBy(*k, "src", "community").agg(F.sum("w").alias("links"), F.max("tot").alias("tot"))
        cand = links.join(at.select(*k, F.col("node").alias("src"), F.col("community").alias("own"), "deg", "m2", F.col("tot").alias("own_tot")), [*k, "src"])
        same = F.col("community") == F.col("own")
        gain = F.round(F.col("links") - F.col("deg") * (F.col("tot") - F.when(same, F.col("deg")).otherwise(0.0)) / F.col("m2"), 9)
        best = cand.withColumn("gain", gain).groupBy(*k, "src").agg(
            F.max_by("community", F.struct("gain", "community")).alias("to"), F.max("gain").alias("best_gain"), F.max(F.when(same, F.col("gain"))).alias("own_gain"),
            F.max(-F.col("deg") * (F.col("own_tot") - F.col("deg")) / F.col("m2")).alias("stay"), *[F.max(c).alias(c) for c in ("own", "deg", "m2")])
        rise = F.col("best_gain") - F.coalesce("own_gain", "stay")
        wants = best.withColumn("rise", rise).where("rise > 1e-8").select(*k, F.col("src").alias("node"), "own", "to", "rise", "deg", "m2")
        wants = materialise(wants, f"wants{i}")
        if wants.isEmpty():
            break
        if i < coin_rounds:
            go = wants.where(F.pmod(hash_int(keyed_md5(level, i, *[F.col(c) for c in k], F.col("node"))), F.lit(2)) == 0)
        else:
            go = _safe(wants, k)
        if k:
            busy = wants.select(*k).distinct()
            done.append(lab.join(busy, k, "left_anti").select(*k, "node", "community"))
            lab, near_by = lab.join(busy, k, "left_semi"), near_by.join(busy, k, "left_semi")
        lab = lab.join(go.select(*k, "node", "to"), [*k, "node"], "left").select(*k, "node", "deg", "m2", F.coalesce("to", "community").alias("community"))
        lab = materialise(lab, f"labels{i}")
        if k and i % 4 == 3:
            near_by = materialise(near_by, "busy")
    else:
        raise RuntimeError("moves did not settle")
    out = lab.select(*k, "node", "community")
    for d in done:
        out = out.unionByName(d)
    return out


def _safe(wants: DataFrame, k: list[str]) -> DataFrame:
    """The moves of ``wants`` (keys, node, own, to, rise, deg, m2) that can be made together, each still a gain of its own.

    A community takes or gives in a round, as its best move says, so a move never meets nodes that leave its goal or
    join its origin. The moves that are left get levels by a keyed coin, half of them each; if all of at least a move's
    level go before it, its goal and its origin have changed by their degrees at the most, and it is made if it gains even
    then. A move that is the best of both its communities has a level of its own, so a round makes one at least. Levels are
    summed up per community: no community's moves are brought together.
    """
    rank = F.struct("rise", "node")
    ends = F.array(F.struct(F.col("own").alias("community"), F.lit(False).alias("joins")), F.struct(F.col("to").alias("community"), F.lit(True).alias("joins")))
    first = wants.select(*k, "rise", "node", F.explode(ends).alias("e")).groupBy(*k, "e.community").agg(F.max_by("e.joins", rank).alias("takes"), F.max(rank).alias("first"))

    def side(name: str) -> DataFrame:
        return first.select(*k, F.col("community").alias(name), F.col("takes").alias(f"_{name}_takes"), F.col("first.node").alias(f"_{name}_first"))
    coin = F.xxhash64(F.lit("level"), *k, "node", "rise")
    heads = F.lit(63) - F.floor(F.log2(F.greatest(F.pmod(coin, F.lit(1 << 62)).cast("double"), F.lit(1.0)))).cast("int")  # leading zeros of the hash
    both = (F.col("node") == F.col("_own_first")) & (F.col("node") == F.col("_to_first"))
    may = (wants.join(side("own"), [*k, "own"]).join(side("to"), [*k, "to"]).where(F.col("_to_takes") & ~F.col("_own_takes"))
           .select(*k, "node", "own", "to", "rise", "deg", "m2", F.when(both, F.lit(99)).otherwise(heads).alias("_level")))
    upto = W.partitionBy(*k, "community", "joins").orderBy(F.col("_level").desc()).rowsBetween(W.unboundedPreceding, 0)
    sums = (may.select(*k, "_level", "deg", F.explode(ends).alias("e")).groupBy(*k, "e.community", "e.joins", "_level").agg(F.sum("deg").alias("d"))
            .withColumn("d", F.sum("d").over(upto)))
    for name in ("own", "to"):
        may = may.join(sums.where(F.col("joins") == F.lit(name == "to")).select(*k, F.col("community").alias(name), "_level", F.col("d").alias(f"_{name}_d")), [*k, name, "_level"])
    others = F.when(F.col("_level") == 99, F.lit(0.0)).otherwise(F.col("_own_d") + F.col("_to_d") - 2 * F.col("deg"))
    return may.where(F.col("rise") - F.col("deg") * others / F.col("m2") > 1e-8).select(*k, "node", "to")


def _wholes(member: DataFrame, graph: DataFrame, total: DataFrame, k: list[str]) -> DataFrame:
    """``member`` with the components whole whose communities score less than they do together."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in k], F.col("node").cast("string"))
    named = graph.select(*k, "src", "dst", "w", *[F.concat_ws("|", *[F.col(c).cast("string") for c in k], F.col(e).cast("string")).alias(f"_{e}") for e in ("src", "dst")])
    parts = components(named.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")))
    each = attach(named.groupBy(*k, F.col("src").alias("node")).agg(F.sum("w").alias("d"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0)).alias("inner")), total, k)
    each = each.withColumn("_n", name).join(parts.select(F.col("node").alias("_n"), F.col("component").alias("_c")), "_n")
    whole = each.groupBy(*k, "_c").agg(F.sum(F.col("inner") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), 2)).alias("apart"), F.sum("d").alias("d"), F.max("m2").alias("m2"), F.min("node").alias("whole"))
    whole = whole.where(F.col("d") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), 2) > F.col("apart") + 1e-12).select(*k, "_c", "whole")
    up = each.join(whole, [*k, "_c"]).select(*k, F.col("node").alias("community"), "whole")
    return member.join(up, [*k, "community"], "left").select(*k, "node", F.coalesce("whole", "community").alias("community"))


def neighbourhood(edges: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """The first n nodes around ``start`` (one row, ``node``) in (level, id) order. Levels are added until
    n nodes are seen or none is new."""
    both = materialise(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "both")
    seen = materialise(start.select("node", F.lit(0).alias("level")), "seen")
    size, level = 1, 0
    while size < n:
        level += 1
        front = seen.where(F.col("level") == level - 1)
        nxt = (front.join(both, front.node == both.src).select(F.col("dst").alias("node")).distinct()
               .join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = materialise(seen.unionByName(nxt), f"seen{level}")
        before, size = size, seen.count()
        if size == before:
            break
    return seen.orderBy("level", "node").limit(n)


def random_walks(edges: DataFrame, walks: int, steps: int, seed: int = 0, cut_every: int = 4) -> DataFrame:
    """(node, walk, path): each step goes to the neighbour at place ``hash mod degree``; repeated edges
    act as weights.

    Neighbour places are numbered once; a walker holds its current node only, and a step is an equi
    join on (node, place), so a hub's adjacency is never gathered.
    """
    return seeded_walks(edges, walks, steps, [seed], cut_every).drop("seed")


def seeded_walks(edges: DataFrame, walks: int, steps: int, seeds: Sequence[int], cut_every: int = 10) -> DataFrame:
    """(seed, node, walk, path): the walks of all seeds, in one pass if the workers can hold the graph (``packed.PLACES``), else in
    one job a step."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    places = hash_rank(both.withColumn("_h", F.md5(F.concat_ws("|", "a", "b"))), ["a"], "_h", ["b"], "place", size="deg")
    places = materialise(places.select("a", "place", "b", "deg"), "places")
    deg = places.groupBy("a").agg(F.max("deg").alias("deg"))
    start = deg.select(F.col("a").alias("node"), F.col("a").alias("cur"), "deg", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    n = places.count()
    if steps > 1 and n <= packed.PLACES:
        some = start.where("node is not null").select("seed", "node")
        parts = max(2 * edges.sparkSession.sparkContext.defaultParallelism, -(-deg.count() * len(seeds) * walks * steps // packed.POSITIONS))
        return packed.held_walks(places, some.repartitionByRange(parts, "seed", "node"), walks, steps)
    w = start.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1)))).withColumn("path", F.array("node"))
    w = w.repartition("seed", "node", "walk")  # few nodes stand for many walkers
    nxt = places.join(deg.select(F.col("a").alias("b"), F.col("deg").alias("next_deg")), "b").select(F.col("a").alias("cur"), "place", "b", "next_deg")
    nxt = materialise(nxt, "next")
    for i in range(1, steps):
        pick = F.pmod(hash_int(keyed_md5(F.col("seed"), "walk", F.col("node"), F.col("walk"), F.lit(i))), F.col("deg")) + 1
        w = w.withColumn("place", pick).join(nxt, ["cur", "place"]).select(
            "seed", "node", F.col("b").alias("cur"), F.col("next_deg").alias("deg"), "walk", F.concat("path", F.array("b")).alias("path"))
        if i % cut_every == 0:
            w = materialise(w, f"walk{i}")
    return w.select("seed", "node", "walk", "path")


def cooccurrences(walks: DataFrame, keys: Sequence[str], window: int = 5, form: str = "rows") -> DataFrame:
    """(keys, node, context, n): how often a context stands within ``window`` steps of a node.

    Pairs are counted by the batch in arrays before they are summed. ``form`` "packed" gives one row (keys, node, contexts, counts) a
    node; "parts" gives such rows before they are summed, for what adds them up itself (``projected_vectors``): no pair is shuffled.
    """
    parts = packed.packed_counts(walks, keys, window)
    if form == "parts":
        return parts
    if form == "packed":
        return packed.merged_counts(parts, keys)
    return packed.unpacked(parts, keys).groupBy(*keys, "node", "context").agg(F.sum("n").alias("n"))


def projected_vectors(pairs: DataFrame, keys: Sequence[str], dims: int = 64, seed: int = 0) -> DataFrame:
    """(keys, node, v): signed projection of the counts of ``cooccurrences``: a context adds its count with a keyed
    sign to every dimension, so the vectors come from one shuffle. Packed rows of numbered nodes, in parts too, are added up where they are read."""
    if "contexts" in pairs.columns:
        if dict(pairs.dtypes)["node"] == "bigint":
            return packed.projected(pairs, keys, dims, seed)
        pairs = packed.unpacked(pairs, keys)
    key = F.to_json(F.struct(*keys))
    shape = T.StructType([pairs.schema[c] for c in keys])
    return _signed(pairs.select(key.alias("g"), "node", "context", F.col("n").cast("double").alias("w")), dims, seed).select(F.from_json("g", shape).alias("g"), "node", "v").select("g.*", "node", "v")


def shifted_ppmi(pairs: DataFrame, keys: Sequence[str], negatives: float = 5.0, smoothing: float = 0.75) -> DataFrame | packed.PackedWeights:
    """(keys, node, context, w): what skip-gram with negative samples factorises, log(n N / (row sum x smoothed context sum))
    less log(negatives), where it is positive. Of the packed counts of ``cooccurrences`` the weights are made by ``factor_vectors`` where it
    reads them."""
    k = list(keys)
    if "contexts" in pairs.columns:
        return packed.PackedWeights(pairs, negatives, smoothing)
    rows = pairs.groupBy(*k, "node").agg(F.sum("n").alias("_r"))
    cols = pairs.groupBy(*k, "context").agg(F.pow(F.sum("n").cast("double"), F.lit(smoothing)).alias("_c"))
    total = cols.groupBy(*k).agg(F.sum("_c").alias("_t"))
    j = attach(pairs.join(rows, [*k, "node"]).join(cols, [*k, "context"]), total, k)
    return j.select(*k, "node", "context", (F.log(F.col("n") * F.col("_t") / (F.col("_r") * F.col("_c"))) - F.lit(float(math.log(negatives)))).alias("w")).where("w > 0")


def factor_vectors(weights: DataFrame | packed.PackedWeights, keys: Sequence[str], dims: int = 64, powers: int = 2, seed: int = 0) -> DataFrame:
    """(keys, node, v): left factors U sqrt(S) of the sparse symmetric-shaped matrix (node, context, w) per key, by a randomised
    range finder.

    A node's row of the matrix times a keyed sign block begins the basis; each power step is two joins and grouped sums
    of arrays, and an orthonormal basis follows from the dims x dims moments of a key, which alone reach the driver. No
    vector set leaves the executors. A key whose rank is below ``dims`` has zeros in the columns beyond it. Packed weights whose
    vector sets the workers can hold (``packed.VECTORS`` numbers a key) are multiplied row by row in place of joins; those sets, some keys at
    a time, pass through the driver.
    """
    k = list(keys)
    if isinstance(weights, packed.PackedWeights):
        def begin(nodes: pa.Array) -> np.ndarray:
            return 1.0 - 2.0 * packed.signs(seed, nodes.to_numpy(), dims)
        if dict(weights.pairs.dtypes)["node"] == "bigint":
            out = packed.factored(weights, k, dims, powers, begin, lambda moments, last: [(_turn if last else _inverse_root)(m) for m in moments])
            if out is not None:
                return out
        weights = shifted_ppmi(packed.unpacked(weights.pairs, k), k, weights.negatives, weights.smoothing)
    key = F.to_json(F.struct(*k)) if k else F.lit("")
    w = materialise(weights.select(key.alias("g"), "node", "context", "w"), "weights")
    y = _signed(w, dims, seed)
    for i in range(powers):
        y = _times(materialise(y, f"basis{i}"), _inverse_roots(y, dims), dims)
        z = _added(w.join(y, ["g", "node"]).select("g", "context", "w", "v"), "context", dims)
        y = _added(w.join(z, ["g", "context"]).select("g", "node", "w", "v"), "node", dims)
    y = materialise(y, "basis")
    q = materialise(_times(y, _inverse_roots(y, dims), dims), "orthonormal")
    b = materialise(_added(w.join(q, ["g", "node"]).select("g", "context", "w", "v"), "context", dims).withColumnRenamed("context", "node"), "inner")
    out = _times(q, {g: _turn(m) for g, m in _moments(b, dims).items()}, dims)  # q' M M' q
    if not k:
        return out.select("node", "v")
    shape = T.StructType([weights.schema[c] for c in k])
    return out.select(F.from_json("g", shape).alias("g"), "node", "v").select("g.*", "node", "v")


def _added(rows: DataFrame, by: str, dims: int) -> DataFrame:
    """Sums of the arrays ``v`` times ``w`` per (g, by), with partial sums before the shuffle."""
    parts = rows.groupBy("g", by).agg(*[F.sum(F.get("v", F.lit(d)) * F.col("w")).alias(f"_{d}") for d in range(dims)])
    return parts.select("g", by, F.array(*[f"_{d}" for d in range(dims)]).alias("v"))


def _signed(rows: DataFrame, dims: int, seed: int) -> DataFrame:
    """Sums of ``w`` per (g, node) under keyed signs of the context: one hash gives the signs of 64 dimensions."""
    hashes = [F.xxhash64(F.lit(seed), F.col("context"), F.lit(j)).alias(f"_h{j}") for j in range((dims + 63) // 64)]
    kept = rows.select("g", "node", "w", *hashes)
    bit = [F.shiftright(F.col(f"_h{d // 64}"), d % 64).bitwiseAND(F.lit(1)) for d in range(dims)]
    parts = kept.groupBy("g", "node").agg(*[F.sum(F.when(b == 0, F.col("w")).otherwise(-F.col("w"))).alias(f"_{d}") for d, b in enumerate(bit)])
    return parts.select("g", "node", F.array(*[f"_{d}" for d in range(dims)]).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _moments(rows: DataFrame, dims: int) -> dict[str, np.ndarray]:
    """v' v per key: dims x dims numbers each."""
    def local(batches):
        held: dict = {}
        for batch in batches:
            names, v = np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(1), dims)
            for g in dict.fromkeys(names.tolist()):
                x = v[names == g]
                held[g] = held.get(g, 0) + x.T @ x
        if held:
            yield pa.RecordBatch.from_pydict({"g": list(held), "m": pa.array([m.tobytes() for m in held.values()], pa.binary())})
    out: dict = {}
    for r in rows.select("g", "v").mapInArrow(local, "g string, m binary").toLocalIterator():
        out[r["g"]] = out.get(r["g"], 0) + np.frombuffer(bytes(r["m"])).reshape(dims, dims)
    return out


def _inverse_roots(rows: DataFrame, dims: int) -> dict[str, np.ndarray]:
    """Per key the matrix that makes the columns of ``v`` orthonormal."""
    return {g: _inverse_root(m) for g, m in _moments(rows, dims).items()}


def _inverse_root(moments: np.ndarray) -> np.ndarray:
    """What makes columns with these moments orthonormal; directions without extent become zero."""
    value, vector = np.linalg.eigh(moments)
    good = value > 1e-10 * max(float(value[-1]), 1e-300)
    return vector * np.where(good, 1 / np.sqrt(np.where(good, value, 1.0)), 0.0)


def _turn(moments: np.ndarray) -> np.ndarray:
    """The turn to the main directions of these moments, scaled by the fourth roots of their sizes."""
    value, vector = np.linalg.eigh(moments)
    order = np.argsort(-value)
    s = np.sqrt(np.sqrt(np.maximum(value[order], 0.0)))
    flip = np.where(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))] < 0, -1.0, 1.0)[order]
    return vector[:, order] * flip * s


def _times(rows: DataFrame, turns: dict[str, np.ndarray], dims: int) -> DataFrame:
    name = [c for c in rows.columns if c not in ("g", "v")][0]

    def run(batches):
        for batch in batches:
            names, v = np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(2), dims).copy()
            for g in dict.fromkeys(names.tolist()):
                v[names == g] = v[names == g] @ turns[g]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), pa.array(v.reshape(-1)))], names=["g", name, "v"])
    return rows.select("g", name, "v").mapInArrow(run, f"g string, {name} {dict(rows.dtypes)[name]}, v array<double>")


def mirror(edges: DataFrame) -> DataFrame:
    """Typed edges (rel, src, dst) plus their reverse relations."""
    return edges.unionByName(edges.select(F.concat(F.lit("rev_"), "rel").alias("rel"), F.col("dst").alias("src"), F.col("src").alias("dst")))


def typed_edges(rows: DataFrame, by_cohort: bool) -> DataFrame:
    """Five relations of the modelling rows in one pass. ``by_cohort`` makes a source one node per
    cohort it supervised (source@t0) instead of one node."""
    s = F.concat(F.lit("s:"), F.col("subject"))
    a = F.concat(F.lit("a:"), F.col("source"), *([F.lit("@"), F.col("t0")] if by_cohort else []))

    def many(rel, src, tags):
        return F.transform(tags, lambda t: F.struct(F.lit(rel).alias("rel"), src.alias("src"), F.concat(F.lit("t:"), t).alias("dst")))

    def one(rel, src, dst, when):
        e = F.array(F.struct(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst")))
        return F.when(when, e).otherwise(F.slice(e, 1, 0))
    all_ = F.concat(many("studies", s, F.col("early_tags")), many("source_studies", a, F.col("source_tags")), one("advises", a, s, F.lit(True)),
                    one("at", s, F.concat(F.lit("i:"), F.col("institution")), F.col("institution").isNotNull()), one("coauth", s, a, F.col("interacted")))
    return rows.select(F.explode(all_).alias("e")).select("e.*").distinct()
