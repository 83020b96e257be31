"""Hard negatives by threshold joins: an inverted index per tile, partial scores, bounds by remaining norms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window

from cohortry.llm.common import DataFrame, F, materialise
from cohortry.llm.whitening import matrix, scaled

TILE = 8192      # rows of an index
BLOCK = 2048     # anchors that meet a tile in one task
TOGETHER = 256   # anchors scored at a time
STRIDE = 8       # dimensions between two prunings
LOWER = (0.7, 0.5, 0.35, 0.2)   # thresholds of the search for positives, as shares of the largest possible score
WINDOW = (0.95, 0.88)           # thresholds of the search for negatives, as shares of the lowest positive score with an open window
SLACK = 1e-9


class Index:
    """An inverted index over the rows of a tile. A dimension has the list of the rows that keep it; a row keeps its
    dimensions up to the one behind which the norm of its rest, times the norm of the largest anchor, stays below the
    lowest threshold: that rest alone cannot reach it. Rows stand by falling number of kept dimensions, so each list is
    a prefix of the rows."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, reach: float, lowest: float):
        rest, dims = suffix_norms(x), x.shape[1]
        kept = (rest[:, :-1] * reach * (1 + SLACK) >= lowest).sum(axis=1) if lowest > 0 else np.full(len(x), dims)
        stop = np.minimum(-(-kept // STRIDE) * STRIDE, dims)
        order = np.argsort(-stop, kind="stable")
        self.keys, self.ids, self.labels, self.x, self.rest, self.stop = keys[order], ids[order], labels[order], x[order], rest[order], stop[order]
        self.wide = self.x.astype(float)

    def above(self, anchors: np.ndarray, labels: np.ndarray, keys: np.ndarray, thresholds: np.ndarray, same: bool):
        """(row, anchor, score) of the pairs of equal (or different) labels whose score reaches the anchor's threshold.

        The lists are read dimension by dimension; a pair lives on while its partial score and the product of the two
        remaining norms reach the threshold. Who lives to the end is scored exactly, with the dimensions left out."""
        dims, rest, wide = anchors.shape[1], suffix_norms(anchors), anchors.astype(float)
        limit = thresholds - SLACK * (np.abs(thresholds) + 1)
        n = int(np.count_nonzero(self.stop))
        alive = ((self.labels[:n, None] == labels) == same) & (self.keys[:n, None] != keys)
        rows, cols, part, scores = None, None, None, np.zeros((n, len(anchors)))
        for j in range(0, dims, STRIDE):
            end = min(j + STRIDE, dims)
            if rows is None:
                listed = int(np.count_nonzero(self.stop > j))
                scores[:listed] += self.wide[:listed, j:end] @ wide[:, j:end].T
                alive[:listed] &= scores[:listed] + self.rest[:listed, end, None] * rest[None, :, end] >= limit
                if 8 * np.count_nonzero(alive) < alive.size:
                    rows, cols = np.nonzero(alive)
                    part, scores = scores[rows, cols], None
            else:
                on = self.stop[rows] > j
                step = np.zeros(len(rows))
                step[on] = np.einsum("ij,ij->i", self.wide[rows[on], j:end], wide[cols[on], j:end])
                part = part + step
                live = ~on | (part + self.rest[rows, end] * rest[cols, end] >= limit[cols])
                rows, cols, part = rows[live], cols[live], part[live]
        if rows is None:
            rows, cols = np.nonzero(alive)
        exact = np.einsum("ij,ij->i", self.x[rows], anchors[cols])
        fits = exact >= thresholds[cols]
        return rows[fits], cols[fits], exact[fits]


def suffix_norms(x: np.ndarray) -> np.ndarray:
    square = np.square(x.astype(float))
    return np.sqrt(np.concatenate([np.cumsum(square[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, by falling score, then id."""
    order = np.lexsort((keys, ids, -score, group))
    g = group[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < most]


def _join(rows: DataFrame, anchors: DataFrame, tiles: int, dims: int, same: bool, most: int) -> DataFrame:
    """(anchor, place, key, vec_id, score) of rows in a window of an anchor, at most the first ``most`` of each tile.

    ``anchors`` has key, label, x, threshold, low and high (arrays: window ``place`` holds the scores between them).
    Tiles of rows and blocks of anchors meet in cells of bounded size; neither side is broadcast."""
    blocks = max(1, -(-anchors.count() // BLOCK))
    left = rows.select(F.pmod(F.xxhash64("key", F.lit("tile")), F.lit(tiles)).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"), "key", "vec_id", "label", "x",
                       F.lit(0).cast("long").alias("threshold"), F.array().cast("array<long>").alias("low"), F.array().cast("array<long>").alias("high"))
    right = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"),
                           "key", "vec_id", "label", "x", "threshold", "low", "high")
    cells = left.unionByName(right).repartition("tile", "block").sortWithinPartitions("tile", "block", "kind")

    def cell(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        kind = t.column("kind").to_numpy()
        cut = int(np.count_nonzero(kind == 0))
        t = t.combine_chunks()
        if not cut or cut == len(kind):
            return
        number = {c: t.column(c).to_numpy() for c in ("key", "vec_id", "label", "threshold")}
        x = matrix(t.column("x").chunk(0), dims)
        anchor, thresholds = x[cut:], number["threshold"][cut:]
        low, high = (matrix(t.column(c).chunk(0).slice(cut), most_windows) for c in ("low", "high"))
        index = Index(number["key"][:cut], number["vec_id"][:cut], number["label"][:cut], x[:cut], float(suffix_norms(anchor)[:, 0].max()), float(thresholds.min()))
        for at in range(0, len(anchor), TOGETHER):
            some = slice(at, at + TOGETHER)
            r, c, score = index.above(anchor[some], number["label"][cut:][some], number["key"][cut:][some], thresholds[some], same)
            for place in range(most_windows):
                lo, hi = low[some, place][c], high[some, place][c]
                fits = (score >= lo) & (score <= hi)
                rr, cc, ss = r[fits], c[fits], score[fits]
                f = _first(cc, ss, index.ids[rr], index.keys[rr], most)
                if len(f):
                    yield pa.RecordBatch.from_pydict({"anchor": number["key"][cut:][some][cc[f]], "place": np.full(len(f), place, np.int32), "key": index.keys[rr[f]], "vec_id": index.ids[rr[f]], "score": ss[f]})
    most_windows = anchors.agg(F.max(F.size("low"))).first()[0] or 0

    def run(batches):
        now, held = None, []
        for batch in batches:
            at = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if now is not None and now != tuple(at[s]):
                        yield from cell(held)
                        held = []
                    now = tuple(at[s])
                    held.append(batch.slice(s, e - s))
        if held:
            yield from cell(held)
    return cells.mapInArrow(run, "anchor long, place int, key long, vec_id long, score long")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _search(rows: DataFrame, anchors: DataFrame, tiles: int, dims: int, same: bool, most: int, shares: tuple[float, ...]) -> DataFrame:
    """(anchor, place, key, vec_id, score, rank): the first ``most`` rows of each window. Anchors begin with a high
    threshold; those with a window that is neither full nor wholly above it go on with the next lower one. The last
    threshold is the windows' lowest bound, so nothing is missed."""
    done, open_ = [], anchors
    for share in (*shares, None):
        floor = F.array_min("low")
        t = floor if share is None else F.greatest(floor, F.floor(F.col("scale") * F.lit(share)).cast("long"))
        now = materialise(open_.withColumn("threshold", t), "anchors")
        if now.isEmpty():
            break
        found = materialise(_ranked(_join(rows, now, tiles, dims, same, most), most), "found")
        full = found.groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most).groupBy("anchor").agg(F.collect_set("place").alias("full"))
        told = now.join(full, now.key == full.anchor, "left").withColumn("full", F.coalesce("full", F.array().cast("array<int>")))
        told = told.withColumn("settled", F.forall(F.sequence(F.lit(0), F.size("low") - 1), lambda i: F.array_contains("full", i) | (F.get("low", i) >= F.col("threshold"))))
        told = materialise(told.drop("anchor", "full"), "told")
        done.append(found.join(told.where("settled").select(F.col("key").alias("anchor")), "anchor", "left_semi"))
        open_ = told.where("not settled").drop("threshold", "settled")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prepared(table: DataFrame) -> DataFrame:
    """(key, vec_id, label, x, norm): rows that take part, repeated ones once. ``table`` has vec_id, label, x."""
    rows = table.where("vec_id is not null and label is not null and x is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "x")
    rows = rows.groupBy("vec_id", "label", F.xxhash64("x").alias("_h"), "x").agg(F.lit(1)).drop("_h")
    return rows.select(F.xxhash64("vec_id", "label", "x").alias("key"), "vec_id", "label", "x", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("norm"))


def mine(table: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least_share: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``table`` has vec_id, label and x (whole numbers). Positives of an anchor are the first other rows of its label by falling
    inner product, then id; negatives of a positive the first rows of other labels that score at most as much as it
    and at least ``least_share`` hundredths. Rows with a null id, label or vector take no part; repeated rows count once; rows that share an
    id but differ are different rows; a shorter vector counts as filled up with zeros; scores must fit in a long.
    """
    rows = materialise(prepared(table), "vectors")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max("norm").alias("m")).first()
    tiles, dims, most_norm = max(1, -(-seen["n"] // TILE)), max(1, seen["d"] or 0), seen["m"] or 0.0
    base = rows.where(is_anchor)
    reach = F.ceil(F.col("norm") * F.lit(most_norm) * (1 + SLACK)).cast("long") + 1
    start = base.select("key", "vec_id", "label", "x", reach.alias("scale"), F.array(-reach).alias("low"), F.array(reach).alias("high"))
    top = materialise(_search(rows, start, tiles, dims, True, positives, LOWER), "positives") if seen["n"] and not start.isEmpty() else None
    if top is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    usable = top.where("score >= 0")
    low = F.ceil(F.col("score") * F.lit(least_share) / F.lit(100)).cast("long")
    windows = usable.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") - 1).alias("i"), low.alias("low"), F.col("score").alias("high")))).alias("w"), F.min("score").alias("scale"))
    asked = base.select("key", "vec_id", "label", "x").join(windows, base.key == windows.anchor).select("key", "vec_id", "label", "x", "scale", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    if asked.isEmpty():
        hard = top.limit(0)
    else:
        hard = _search(rows, asked, tiles, dims, False, negatives, WINDOW)
    hard = hard.select(F.col("anchor").alias("_a"), F.col("place").alias("_p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = top.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = base.select(F.col("key").alias("_k"), F.col("vec_id").alias("anchor_id"))
    return (pos.join(hard, (F.col("anchor") == F.col("_a")) & (F.col("place") == F.col("_p"))).join(names, F.col("anchor") == F.col("_k"))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
