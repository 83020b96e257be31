"""Boosted trees for many keys at once: one model per (group, part), from histograms formed where the rows lie.

A level of all trees is one pass: each task adds up gradients by (node, column, bin) for every model, the sums are
added per model on the executors, and the best split of each node is chosen there too. What reaches the driver is one
split per node. No row is copied per model and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.session import materialise

SLICE = 8192
FRESH = 16  # trees that a pass applies itself; older ones are in the stored margins


@dataclass
class Tree:
    """Nodes in order of their making: the left child of node i is child[i], the right one the next; -1 marks a leaf."""

    column: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        column, cut, child = np.array(self.column), np.array(self.cut), np.array(self.child)
        while (inner := child[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            at[rows] = child[n] + (bins[rows, column[n]] > cut[n])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Boosted:
    edges: dict[str, list[np.ndarray]]
    start: dict[tuple[str, int], float]
    trees: dict[tuple[str, int], list[Tree]]
    losses: dict[tuple[str, int], list[float]]

    def parts(self, group: str) -> list[int]:
        return sorted(k for g, k in self.start if g == group)


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)


def column_edges(rows: DataFrame, dims: int, bins: int) -> dict[str, list[np.ndarray]]:
    """Upper ends of the bins per group and column, from quantiles: bins x columns numbers a group."""
    at = [i / bins for i in range(1, bins)]
    got = rows.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], at, 100 * bins).alias(f"e{i}") for i in range(dims)]).collect()
    return {r["grp"]: [np.unique(np.array(r[f"e{i}"] or [], float)) for i in range(dims)] for r in got}


def _blocks(batches, dims: int):
    """(group, y, bins, members, margins) of the rows of one group in a slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            names = np.array(part.column(0).to_pylist(), object)
            y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
            b = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, dims)
            m = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            f = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for name in dict.fromkeys(names.tolist()):
                own = np.flatnonzero(names == name)
                yield name, y[own], b[own], m[own], f[own], part, own


def _best(sums: np.ndarray, least: int, ridge: float) -> np.ndarray:
    """A row per node: gain, column, cut, then gradient, second derivative and count of the left side and of the node."""
    nodes, _, dims, bins = sums.shape
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :1, -1:]
    right = whole - left

    def worth(s):
        return np.square(s[:, 0]) / (s[:, 1] + ridge)
    gain = np.where((left[:, 2] >= least) & (right[:, 2] >= least), worth(left) + worth(right) - worth(whole), -np.inf)
    flat = gain.reshape(nodes, -1)
    pick = np.argmax(np.round(flat, 9), axis=1)  # of equal gains the first column and cut
    column, cut = pick // bins, pick % bins
    at = np.arange(nodes)
    return np.column_stack([flat[at, pick], column, cut, left[at, :, column, cut], whole[:, :, 0, 0]])


def fit_boosted(train: DataFrame, dims: int, rounds: int = 500, depth: int = 5, rate: float = 0.1, least: int = 20, bins: int = 64, patience: int = 10, ridge: float = 1e-6) -> Boosted:
    """Models of ``train`` (grp, y, x, members): logistic loss, each on the rows of its group that it is a member of; on the
    others its loss is watched, and a model stops once ``patience`` rounds have not lowered it. A model without rows to watch runs for all
    rounds; one whose labels are all alike has no trees."""
    edges = column_edges(train, dims, bins)
    parts = (train.select(F.size("members").alias("n")).first() or [0])[0]

    def to_bins(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            b = np.zeros((len(names), dims), np.uint8)
            for g in dict.fromkeys(names.tolist()):
                b[names == g] = binned(x[names == g], edges[g])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in b], pa.binary()), batch.column(3), pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * parts), pa.array(np.zeros(len(names) * parts)))], names=["grp", "y", "b", "members", "f"])
    kind = "grp string, y double, b binary, members array<boolean>, f array<double>"
    rows = materialise(train.select("grp", "y", "x", "members").mapInArrow(to_bins, kind), "binned")
    n = rows.select("grp", "y", F.posexplode("members").alias("part", "m")).where("m").groupBy("grp", "part").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()  # one row per model
    model = Boosted(edges, {(r["grp"], r["part"]): float(np.log((r["p"] + 0.5) / (r["n"] - r["p"] + 0.5))) for r in n}, {(r["grp"], r["part"]): [] for r in n}, {(r["grp"], r["part"]): [] for r in n})
    live = {(r["grp"], r["part"]) for r in n if 0 < r["p"] < r["n"]}
    stored = 0
    for done in range(rounds):
        if not live:
            break
        if done - stored >= FRESH:
            rows, stored = materialise(_advanced(rows, model, stored, dims, kind), f"margins{done}"), done
        grown, open_ = {k: Tree() for k in live}, {k: [0] for k in live}
        for level in range(depth):
            if not open_:
                break
            found = _level(rows, model, grown, open_, stored, dims, bins, least, ridge, level == 0)
            following: dict = {}
            for key, (splits, loss) in found.items():
                if level == 0:
                    model.losses[key].append(loss)
                tree = grown[key]
                for node, (gain, column, cut, gl, hl, nl, g, h, c) in zip(open_[key], splits):
                    if level == 0:
                        tree.value[0] = -rate * g / (h + ridge)
                    if gain > 1e-9:
                        tree.column[node], tree.cut[node], tree.child[node] = int(column), int(cut), len(tree.child)
                        for a, b, size in ((gl, hl, nl), (g - gl, h - hl, c - nl)):
                            if size >= 2 * least:
                                following.setdefault(key, []).append(len(tree.child))
                            tree.column.append(0)
                            tree.cut.append(0)
                            tree.child.append(-1)
                            tree.value.append(-rate * a / (b + ridge))
            open_ = following
        for key in list(live):
            model.trees[key].append(grown[key])
            seen = model.losses[key]
            if len(grown[key].child) == 1 or (len(seen) > patience and min(seen[-patience:]) >= min(seen[:-patience]) - 1e-7 and np.isfinite(seen[-1])):
                live.discard(key)
    return model


def _margins(model: Boosted, group: str, k: int, held: np.ndarray, bins: np.ndarray, stored: int) -> np.ndarray:
    out = held + (model.start[group, k] if not stored else 0.0)
    for tree in model.trees[group, k][stored:]:
        out = out + tree.scores(bins)
    return out


def _advanced(rows: DataFrame, model: Boosted, stored: int, dims: int, kind: str) -> DataFrame:
    def run(batches):
        for name, _, b, m, f, part, own in _blocks(batches, dims):
            f = f.copy()
            for k in model.parts(name):
                f[:, k] = _margins(model, name, k, f[:, k], b, stored)
            some = part.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*[some.column(i) for i in range(4)], pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.reshape(-1)))], names=["grp", "y", "b", "members", "f"])
    return rows.mapInArrow(run, kind)


def _level(rows, model, grown, open_, stored, dims, bins, least, ridge, first) -> dict:
    """Per model the best split of each open node, and before the first level the mean loss of the rows it watches."""
    def local(batches):
        held: dict = {}
        for name, y, b, m, f, _, _ in _blocks(batches, dims):
            for key in [k for k in open_ if k[0] == name]:
                margin = _margins(model, name, key[1], f[:, key[1]], b, stored)
                p = 1 / (1 + np.exp(-margin))
                fit = m[:, key[1]]
                leaf = grown[key].leaves(b)
                slot = np.full(len(grown[key].child), -1)
                slot[open_[key]] = np.arange(len(open_[key]))
                at = slot[leaf]
                use = np.flatnonzero(fit & (at >= 0))
                place = ((at[use, None] * dims + np.arange(dims)) * bins + b[use]).reshape(-1)
                size = len(open_[key]) * dims * bins
                w = [np.bincount(place, np.repeat(v[use], dims), size).reshape(-1, 1, dims, bins) for v in (p - y, p * (1 - p), np.ones(len(y)))]
                watch = ~fit
                loss = np.logaddexp(0, margin[watch]) - y[watch] * margin[watch] if first else np.zeros(0)
                own = np.concatenate([np.concatenate(w, axis=1).reshape(-1), [loss.sum(), len(loss)]])
                held[key] = held[key] + own if key in held else own
        if held:
            yield pa.RecordBatch.from_pydict({"grp": [k[0] for k in held], "part": pa.array([k[1] for k in held], pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    def chosen(key, total):
        best = _best(total[:-2].reshape(-1, 3, dims, bins), least, ridge)
        return pa.RecordBatch.from_pydict({"grp": [key[0]], "part": pa.array([key[1]], pa.int32()), "sums": pa.array([np.append(best.reshape(-1), total[-2:]).tobytes()], pa.binary())})

    def add(batches):
        now, total = None, None
        for batch in batches:
            for name, part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = np.frombuffer(sums.as_py())
                if now == (name, part):
                    total = total + got
                else:
                    if now is not None:
                        yield chosen(now, total)
                    now, total = (name, part), got
        if now is not None:
            yield chosen(now, total)
    kind = "grp string, part int, sums binary"
    out = {}
    for r in rows.mapInArrow(local, kind).repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(add, kind).collect():  # a row per model
        a = np.frombuffer(bytes(r["sums"]))
        out[r["grp"], r["part"]] = a[:-2].reshape(-1, 9), float(a[-2] / a[-1]) if a[-1] else float("nan")
    return out


def boosted_scores(rows: DataFrame, model: Boosted, keep: Sequence[str], dims: int, staged: bool = False) -> DataFrame:
    """``keep``, part and the probability, one row per row and model of its group; ``staged`` gives a row for every
    round too. ``rows`` has grp, x and the kept columns."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names = np.array(part.column(0).to_pylist(), object)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                for name in dict.fromkeys(names.tolist()):
                    if name not in model.edges:
                        continue
                    own = np.flatnonzero(names == name)
                    b = binned(x[own], model.edges[name])
                    held = part.take(pa.array(own))
                    for k in model.parts(name):
                        margin = np.full(len(own), model.start[name, k])
                        trees = model.trees[name, k]
                        for i, tree in enumerate(trees):
                            margin = margin + tree.scores(b)
                            if staged or i == len(trees) - 1:
                                yield _scored(held, keep, k, i + 1, margin)
                        if not trees:
                            yield _scored(held, keep, k, 0, margin)
    out = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", part int, round int, score double"
    return rows.select("grp", "x", *keep).mapInArrow(run, out)


def _scored(held: pa.RecordBatch, keep: Sequence[str], part: int, number: int, margin: np.ndarray) -> pa.RecordBatch:
    n = len(margin)
    return pa.RecordBatch.from_arrays([*[held.column(2 + i) for i in range(len(keep))], pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(1 / (1 + np.exp(-margin)))], names=[*keep, "part", "round", "score"])
