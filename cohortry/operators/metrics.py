"""Ranking metrics on long score tables: one row per (group..., row) with ``y`` and ``score``.

All groups (fields, models, seeds, draws) are evaluated in one job. Scores are aggregated per
distinct value before any ordering, so ties are exact and a hot group costs its distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortry.operators.draws import resample_matrix
from cohortry.operators.ordering import cumulate
from cohortry.session import materialise


def _curve(scores: DataFrame, group: Sequence[str], y: str, score: str, weight: str | None, descending=True) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    return cumulate(scores, group, score, {"pos": F.col(y).cast("bigint") * w, "n": w.cast("bigint")}, descending=descending)


def average_precision(scores: DataFrame, group: Sequence[str], y: str = "y", score: str = "score",
                      weight: str | None = None) -> DataFrame:
    """Sum over distinct scores of recall step x precision; 0 without positives. Adds positives and rows."""
    c = _curve(scores, group, y, score, weight)
    step = F.try_divide(F.col("pos").cast("double"), F.col("tot_pos").cast("double")) * (F.col("cum_pos").cast("double") / F.col("cum_n"))
    return c.groupBy(*group).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("ap"), F.max("tot_pos").alias("positives"), F.max("tot_n").alias("rows"))


def auc_roc(scores: DataFrame, group: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half; null if one class is absent."""
    c = _curve(scores, group, y, score, None, descending=False)
    neg = F.col("n") - F.col("pos")
    below = (F.col("cum_n") - F.col("cum_pos")) - neg
    wins = F.sum(F.col("pos") * (below + neg / F.lit(2.0)))
    p, n = F.max("tot_pos").cast("double"), F.max("tot_n").cast("double")
    return c.groupBy(*group).agg(F.try_divide(wins, p * (n - p)).alias("auc"), F.max("tot_n").alias("rows"))


def best_f1_threshold(scores: DataFrame, group: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Threshold with the largest F1 (lowest threshold on ties)."""
    c = _curve(scores, group, y, score, None)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("cum_pos"), F.col("cum_n") + F.col("tot_pos")), F.lit(0.0))
    return c.groupBy(*group).agg(F.max_by(F.struct(F.col(score).alias("threshold"), f1.alias("f1")), F.struct(f1.alias("f"), (-F.col(score)).alias("s"))).alias("b")).select(*group, "b.*")


def f1_at(scores: DataFrame, group: Sequence[str], threshold: Column, y: str = "y", score: str = "score") -> DataFrame:
    hit = F.col(score) >= threshold
    tp, fp, fn = F.count_if(hit & (F.col(y) == 1)), F.count_if(hit & (F.col(y) == 0)), F.count_if(~hit & (F.col(y) == 1))
    return scores.groupBy(*group).agg(F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"))


HELD = 256  # rows whose weights of all draws a task holds at a time, and draws of a cell
CELL = (1 << 22, 1 << 18)  # rows and keys of groups that share their keys, above which they are streamed in place of held


def resampled_precision(scores: DataFrame, group: Sequence[str], key: str, draws: int, y: str = "y", score: str = "score", share: Sequence[str] | None = None) -> DataFrame:
    """(group, draw, ap, positives, rows): average precision of each group under each resample (``resample_weights``).

    ``share`` names the group columns whose groups have keys in common (all of them if it is not given). A cell is what
    shares keys, for a block of draws: a task digests each key of a cell once and folds its weights to the distinct scores of
    every group. What is shuffled is a row per key and block with its scores, never rows times draws. Groups of more than ``CELL`` rows or
    keys are streamed by ranges of scores.
    """
    g = list(group)
    unit = F.to_json(F.struct(*(g if share is None else list(share))))
    flat = scores.select(unit.alias("u"), F.to_json(F.struct(*g)).alias("g"), F.col(key).cast("string").alias("k"), F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("s"))
    keyed = materialise(flat.groupBy("u", "k").agg(F.collect_list(F.struct("g", "y", "s")).alias("r")), "keyed")
    sizes = keyed.groupBy("u").agg(((F.sum(F.size("r")) <= CELL[0]) & (F.count(F.lit(1)) <= CELL[1])).alias("small")).collect()
    small, large = [r["u"] for r in sizes if r["small"]], [r["u"] for r in sizes if not r["small"]]
    blocks = -(-draws // HELD)
    out = None
    if small:
        cells = (keyed if not large else keyed.where(~F.col("u").isin(large))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        out = (cells.repartition(min(2 * blocks * len(small), 4096), "u", "block").sortWithinPartitions("u", "block").select("u", "block", "k", "r")
               .mapInArrow(_cells(draws), "g string, draw int, ap double, positives long, rows long"))
    if large or not small:
        rows = keyed.where(F.col("u").isin(large)).select(F.explode("r").alias("r"), "k").select("r.g", "k", "r.y", "r.s")
        streamed = _streamed_precision(rows, draws)
        out = streamed if out is None else out.unionByName(streamed)
    shape = T.StructType([scores.schema[c] for c in g])
    return out.select(F.from_json("g", shape).alias("g"), "draw", "ap", "positives", "rows").select("g.*", "draw", "ap", "positives", "rows")


def _cells(draws: int):
    """Average precisions of the cells (u, block, k, r) of a task, which come one after the other."""
    def run(batches):
        now, cell = None, None
        for batch in batches:
            u = batch.column(0).dictionary_encode().indices.to_numpy().astype(np.int64) * draws + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(u[1:] != u[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    at = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py())
                    if at != now:
                        if cell is not None:
                            yield from cell.done()
                        now, cell = at, _Cell(at[1] * HELD, min(HELD, draws - at[1] * HELD))
                    cell.take(batch.slice(lo, hi - lo))
        if cell is not None:
            yield from cell.done()
    return run


class _Cell:
    """The rows of a cell and the weights of its keys under a block of draws."""

    def __init__(self, first: int, wide: int):
        self.first, self.wide, self.names, self.keys = first, wide, {}, 0
        self.weights, self.rows = [], []

    def take(self, batch: pa.RecordBatch) -> None:
        for i in range(0, batch.num_rows, HELD):
            self.weights.append(resample_matrix(batch.column(2).slice(i, HELD).to_pylist(), self.wide, first=self.first))
        r = batch.column(3).flatten()
        code = r.field(0).dictionary_encode()
        names = np.array([self.names.setdefault(n, len(self.names)) for n in code.dictionary.to_pylist()], np.int32)
        s = r.field(2).to_numpy(zero_copy_only=False)
        late = np.where(r.field(2).is_null().to_numpy(zero_copy_only=False), 2, np.where(np.isnan(s), 0, 1)).astype(np.int8)  # falling order: NaN, numbers, null
        at = np.repeat(np.arange(self.keys, self.keys + batch.num_rows, dtype=np.int32), pc.list_value_length(batch.column(3)).to_numpy())
        self.rows.append((names[code.indices.to_numpy()], at, r.field(1).to_numpy(zero_copy_only=False).astype(float), s, late))
        self.keys += batch.num_rows

    def done(self):
        """For each group a batch with its average precision under the draws of the block."""
        weights = np.concatenate(self.weights)
        group, at, y, s, late = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((-s, late, group))
        ends = np.searchsorted(group[order], np.arange(len(self.names) + 1))
        for name, lo, hi in zip(self.names, ends, ends[1:]):
            own = order[lo:hi]
            new = np.append(True, s[own][1:] != s[own][:-1])
            n = _folded(weights, at[own], None, np.flatnonzero(new))
            hits = y[own] != 0
            place, mine = (np.cumsum(new) - 1)[hits], own[hits]
            pos = np.zeros(n.shape)
            if len(mine):
                start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                pos[place[start]] = _folded(weights, at[mine], None if (y[mine] == 1).all() else y[mine], start)
            run_pos, run_n = np.cumsum(pos, axis=0), np.cumsum(n, axis=0)
            total = np.stack([(pos * run_pos / np.maximum(run_n, 1)).sum(axis=0), run_pos[-1], run_n[-1]])
            yield _draw_rows(name, total, self.first)


def _folded(weights: np.ndarray, rows: np.ndarray, by: np.ndarray | None, start: np.ndarray) -> np.ndarray:
    """Sums of the weights of ``rows`` (times ``by``) from each place of ``start`` to the next, some thousand rows at a time."""
    out, ends = np.empty((len(start), weights.shape[1])), np.append(start, len(rows))
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 16 * HELD, side="right")) - 1)
        total = None
        for a in range(ends[i], ends[j], 16 * HELD):  # one score may have more rows
            b = min(a + 16 * HELD, ends[j])
            w = weights[rows[a:b]]
            w = w if by is None else w * by[a:b, None]
            got = np.add.reduceat(w, np.maximum(ends[i:j] - a, 0), axis=0, dtype=np.uint16 if by is None else float)  # 4,096 weights of 12 at most
            total = got.astype(float) if total is None else total + got
        out[i:j] = total
        i = j
    return out


def _streamed_precision(flat: DataFrame, draws: int) -> DataFrame:
    """(g, draw, ap, positives, rows) of rows (g, k, y, s).

    Rows are dealt by range of (group, falling score), so a group may lie in many parts. Each part adds up the weights
    of all draws; the totals of the parts before it are where its running sums begin; then one pass in score order
    carries the sums of all draws as arrays. What is shuffled is rows and one array per part and group, never rows
    times draws. Equal scores always share a part, so ties are exact.
    """
    dealt = materialise(flat.repartitionByRange("g", F.desc("s")).withColumn("part", F.spark_partition_id()), "ranked")

    def totals(batches):
        held: dict = {}
        for batch in batches:
            for g_, part, y_, w in _weighted(batch, draws):
                t = held.setdefault((g_, part), np.zeros(2 * draws))
                t += np.concatenate([y_ @ w, w.sum(axis=0)])
        if held:
            yield _sums(held)
    sums = dealt.select("g", "part", "k", "y", "s").mapInArrow(totals, "g string, part int, held binary")

    def before(batches):
        now, parts = None, []
        for batch in batches:
            for g_, part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g_ != now:
                    yield from _offsets(now, parts)
                    now, parts = g_, []
                got = np.frombuffer(held.as_py())
                if parts and parts[-1][0] == part:
                    parts[-1] = (part, parts[-1][1] + got)
                else:
                    parts.append((part, got))
        yield from _offsets(now, parts)
    starts = sums.repartition("g").sortWithinPartitions("g", "part").mapInArrow(before, "g string, part int, held binary")
    both = (dealt.select("g", "part", F.lit(1).alias("kind"), "k", "y", "s", F.lit(None).cast("binary").alias("held"))
            .unionByName(starts.select("g", "part", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("double").alias("s"), "held")))

    def curve(batches):
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                b = batch.slice(at, HELD)
                ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                kind = b.column(2).to_numpy()
                cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or kind[i] != kind[i - 1]], len(ids)]
                for lo, hi in zip(cuts, cuts[1:]):
                    if kind[lo] == 0:
                        if state is not None:
                            yield state.done()
                        state = _Curve(ids[lo][0], np.frombuffer(b.column(6)[lo].as_py()), draws)
                    else:
                        part = b.slice(lo, hi - lo)
                        state.take(part.column(5).to_numpy(), part.column(4).to_numpy().astype(float), resample_matrix(part.column(3).to_pylist(), draws))
        if state is not None:
            yield state.done()
    partial = both.repartition("part", "g").sortWithinPartitions("part", "g", "kind", F.desc("s")).mapInArrow(curve, "g string, held binary")

    def whole(batches):
        now, total = None, None
        for batch in batches:
            for g_, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.frombuffer(held.as_py()).reshape(3, draws)
                if g_ == now:
                    total = np.stack([total[0] + got[0], got[1], got[2]])
                else:
                    if now is not None:
                        yield _draw_rows(now, total)
                    now, total = g_, got
        if now is not None:
            yield _draw_rows(now, total)
    return partial.repartition("g").sortWithinPartitions("g").mapInArrow(whole, "g string, draw int, ap double, positives long, rows long")


def _weighted(batch: pa.RecordBatch, draws: int):
    """(group, part, labels, weights) of the rows of one group and part in a slice."""
    for at in range(0, batch.num_rows, HELD):
        b = batch.slice(at, HELD)
        ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        w, labels = resample_matrix(b.column(2).to_pylist(), draws).astype(float), b.column(3).to_numpy().astype(float)
        for one in dict.fromkeys(ids):
            own = np.array([i == one for i in ids])
            yield *one, labels[own], w[own]


def _sums(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"g": pa.array([k[0] for k in held]), "part": pa.array([k[1] for k in held], pa.int32()), "held": pa.array([v.tobytes() for v in held.values()], pa.binary())})


def _offsets(name, parts: list):
    """For each part of a group: sums of the parts before it, then the totals of the group."""
    if parts:
        total, run, out = sum(p for _, p in parts), np.zeros(len(parts[0][1])), {}
        for part, own in parts:
            out[name, part] = np.concatenate([run, total])
            run = run + own
        yield _sums(out)


class _Curve:
    """Running sums of all draws down the ranking of one group and part. A score's rows count together, so the last
    score of a slice waits for the next."""

    def __init__(self, name: str, held: np.ndarray, draws: int):
        self.name, self.pos, self.n, self.all_pos, self.all_n = name, *[a.copy() for a in held.reshape(4, draws)]
        self.ap, self.wait, self.add = np.zeros(draws), None, np.zeros((2, draws))

    def take(self, scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        start = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        w = weights.astype(float)
        pos, n = np.add.reduceat(w * labels[:, None], start, axis=0), np.add.reduceat(w, start, axis=0)
        if self.wait is not None:
            if self.wait == scores[0]:
                pos[0] += self.add[0]
                n[0] += self.add[1]
            else:
                pos, n = np.vstack([self.add[:1], pos]), np.vstack([self.add[1:], n])
        self.wait, self.add = scores[-1], np.stack([pos[-1], n[-1]])
        self._count(pos[:-1], n[:-1])

    def _count(self, pos: np.ndarray, n: np.ndarray) -> None:
        if len(pos):
            run_pos, run_n = self.pos + np.cumsum(pos, axis=0), self.n + np.cumsum(n, axis=0)
            self.ap += (pos * run_pos / np.maximum(run_n, 1)).sum(axis=0)
            self.pos, self.n = run_pos[-1], run_n[-1]

    def done(self) -> pa.RecordBatch:
        if self.wait is not None:
            self._count(self.add[:1], self.add[1:])
        return pa.RecordBatch.from_pydict({"g": [self.name], "held": pa.array([np.stack([self.ap, self.all_pos, self.all_n]).tobytes()], pa.binary())})


def _draw_rows(name: str, total: np.ndarray, first: int = 0) -> pa.RecordBatch:
    k = total.shape[1]
    ap = np.where(total[1] > 0, total[0] / np.maximum(total[1], 1), 0.0)
    return pa.RecordBatch.from_pydict({"g": pa.array([name] * k), "draw": pa.array(np.arange(first, first + k, dtype=np.int32)), "ap": ap, "positives": total[1].astype(np.int64), "rows": total[2].astype(np.int64)})
