"""Whitening by an incremental eigendecomposition: rank-one updates, secular equations, Rayleigh-Ritz."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cohortry.llm.common import DataFrame, F, T, materialise

SCALE = 256
KEPT = 4       # components returned
BLOCK = 2048   # rows that are folded to one triangular factor before they update a spectrum
FAN = 16       # spectra one task combines
SLICE_ROWS = 8192
EPS = np.finfo(float).eps


def scaled(column: str = "embedding", scale: int = SCALE):
    """The vector as whole numbers: floor(scale * component), null where the vector takes no part."""
    v = F.col(f"`{column}`")
    wide = F.transform(v, lambda c: c.cast("double"))
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & fine, F.transform(wide, lambda c: F.floor(F.lit(scale) * c).cast("long")))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of long vectors as one matrix; a shorter vector is filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j^2 / (d_j - x) = 0 for ascending distinct poles d and nonzero z.

    Each root is returned as (pole, offset), the pole being the nearer end of its interval, so that the
    distances root - d_j keep their relative accuracy. Steps interpolate both neighbouring poles; a step that leaves
    the bracket becomes a bisection.
    """
    k, w = len(d), z * z
    right = np.append(d[1:], d[-1] + w.sum())
    gap = right - d
    middle = d + gap / 2
    at_middle = 1 + (w / (d - middle[:, None])).sum(axis=1)
    left = at_middle >= 0
    left[-1] = True  # the last root has no pole on its right
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    shift = d - d[pole][:, None]  # row i: the poles seen from the pole of root i
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    off = (low + high) / 2
    below = np.tri(k, dtype=bool)  # poles up to the root's own
    todo = np.arange(k)
    for _ in range(100):
        delta = shift[todo] - off[todo][:, None]
        term = w / delta
        f = 1 + term.sum(axis=1)
        done = (np.abs(f) <= 4 * EPS * k * (1 + np.abs(term).sum(axis=1))) | (high[todo] - low[todo] <= 2 * EPS * np.abs(off[todo]))
        low[todo] = np.where(f < 0, off[todo], low[todo])
        high[todo] = np.where(f >= 0, off[todo], high[todo])
        slope = term / delta
        rise_low, rise_high = (slope * below[todo]).sum(axis=1), (slope * ~below[todo]).sum(axis=1)
        mine = delta[np.arange(len(todo)), todo]
        other = np.where(todo == k - 1, 0.0, delta[np.arange(len(todo)), np.minimum(todo + 1, k - 1)])
        with np.errstate(all="ignore"):
            c = f - mine * rise_low - other * rise_high
            a = (mine + other) * f - mine * other * (rise_low + rise_high)
            b = mine * other * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step = np.where(todo == k - 1, mine + mine * mine * rise_low / (f - mine * rise_low), step)
            new = off[todo] + step
        inside = np.isfinite(new) & (new > low[todo]) & (new < high[todo])
        new = np.where(inside, new, (low[todo] + high[todo]) / 2)
        off[todo] = np.where(done, off[todo], new)
        todo = todo[~done]
        if not len(todo):
            break
    return pole, off


def rank_one(values: np.ndarray, vectors: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of vectors @ diag(values) @ vectors.T + u u^T; ``values`` ascend.

    Entries of z = vectors.T @ u that do not count, and one of two poles that agree, are deflated: their pairs stay
    (after a plane rotation). For the rest the secular equation is solved, and z is formed anew from its
    roots, which keeps the new vectors orthogonal however close the roots lie.
    """
    z = vectors.T @ u
    size = max(float(np.abs(values).max(initial=0.0)), float(z @ z))
    if size == 0.0:
        return values, vectors
    tol = 8 * EPS * size
    vectors = vectors.copy()
    live: list[int] = []
    for i in np.flatnonzero(np.abs(z) * np.sqrt(float(z @ z)) > tol).tolist():
        if live and values[i] - values[live[-1]] <= tol:
            j = live[-1]
            r = float(np.hypot(z[i], z[j]))
            c, s = z[i] / r, z[j] / r
            vectors[:, [j, i]] = np.column_stack([c * vectors[:, j] - s * vectors[:, i], s * vectors[:, j] + c * vectors[:, i]])
            z[j], z[i] = 0.0, r
            live[-1] = i
        else:
            live.append(i)
    if not live:
        return values, vectors
    at = np.array(live)
    d, w = values[at], z[at]
    pole, off = secular_roots(d, w)
    away = (d[pole][:, None] - d) + off[:, None]  # root i - pole j
    k = len(at)
    next_up = (d[1:, None] - d)  # the roots interlace with the poles: each is divided by the distance of a pole beside it
    own = d[:-1, None] - d
    ratio = away.copy()
    ratio[:-1] /= np.where(np.arange(k) <= np.arange(k - 1)[:, None], next_up, own)
    fresh = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(w)
    turn = fresh[:, None] / (-away.T)
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values = values.copy()
    values[at] = d[pole] + off
    vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenpairs of the scatter (the sum of centred outer products) of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims))

    def shift(self, n: int, mean: np.ndarray) -> None:
        """The rank-one part that ``n`` more rows around ``mean`` add, and the new mean."""
        if self.n and n:
            u = (mean - self.mean) * np.sqrt(self.n * n / (self.n + n))
            self.values, self.vectors = rank_one(self.values, self.vectors, u)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n)) if n else self.mean
        self.n += n

    def add_rows(self, rows: np.ndarray) -> None:
        """Centred rank-one updates by the rows. More rows than dimensions are folded first: the rows of the
        triangular factor of the centred block have the same sum of outer products."""
        mean = rows.mean(axis=0)
        centred = rows - mean
        self.shift(len(rows), mean)
        for u in np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred:
            self.values, self.vectors = rank_one(self.values, self.vectors, u)

    def add(self, other: Spectrum) -> None:
        """The other spectrum's pairs, one rank-one update each, and the shift between the means."""
        self.shift(other.n, other.mean)
        for value, v in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, v * np.sqrt(value))

    def packed(self) -> bytes:
        return struct.pack("<qq", self.n, len(self.mean)) + np.concatenate([self.mean, self.values, self.vectors.reshape(-1)]).tobytes()

    @classmethod
    def unpacked(cls, held: bytes) -> Spectrum:
        n, d = struct.unpack("<qq", held[:16])
        a = np.frombuffer(held, np.float64, offset=16)
        return cls(n, a[:d].copy(), a[d:2 * d].copy(), a[2 * d:].reshape(d, d).copy())


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector ``x`` once. Copies are folded before the shuffle."""
    return rows.select("x").distinct()


def spectrum(vectors: DataFrame, dims: int, block: int = BLOCK, fan: int = FAN) -> Spectrum:
    """The spectrum of all ``x``: one per task, then combined ``fan`` by ``fan`` on the executors until one is left."""
    def local(batches):
        own = Spectrum.empty(dims)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                own.add_rows(matrix(batch.column(0).slice(at, block), dims).astype(float))
        if own.n:
            yield _one(0, own)
    parts = materialise(vectors.select("x").mapInArrow(local, "at long, held binary"), "spectra")
    left = parts.count()

    def combine(batches):
        now = None
        for batch in batches:
            for key, held in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = Spectrum.unpacked(held.as_py())
                if now is None or now[0] != key:
                    if now:
                        yield _one(*now)
                    now = (key, one)
                else:
                    now[1].add(one)
        if now:
            yield _one(*now)
    while left > 1:
        left = -(-left // fan)
        groups = parts.select(F.pmod(F.xxhash64("held"), F.lit(left)).alias("at"), "held").repartition("at").sortWithinPartitions("at", "held")
        parts = materialise(groups.mapInArrow(combine, "at long, held binary"), "spectra")
        left = min(left, parts.count())
    return Spectrum.unpacked(bytes(parts.first()["held"]))


def _one(key: int, held: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": pa.array([key], pa.int64()), "held": pa.array([held.packed()], pa.binary())})


def _moments(vectors: DataFrame, centre: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second moments of (x - centre) @ basis over all rows, summed on the executors."""
    dims, k = basis.shape

    def local(batches):
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                y = (matrix(batch.column(0).slice(at, SLICE_ROWS), dims) - centre) @ basis
                total += y.sum(axis=0)
                square += y.T @ y
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(k * k + k, dtype=np.int32)), "part": pa.array(np.concatenate([total, square.reshape(-1)]))})
    got = vectors.select("x").mapInArrow(local, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()  # k * k + k numbers
    out = np.zeros(k * k + k)
    for r in got:
        out[r["place"]] = r["part"]
    return out[:k], out[k:].reshape(k, k)


@dataclass
class Whitening:
    """``sums`` are exact; the columns of ``components`` are unit eigenvectors by falling ``variances``."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(rows: DataFrame, kept: int = KEPT, block: int = BLOCK) -> Whitening | None:
    """Whitening of the distinct vectors ``x`` of ``rows``; None without vectors.

    The combined spectrum gives a basis; one pass more over all rows forms the covariance in that basis (of centred
    rows) and its eigenvectors turn the basis to the components. Another pass measures how far the whitened rows'
    covariance is from the identity. A component without variance has no whitened value and takes no part in it.
    """
    vectors = materialise(fit_list(rows), "fit")
    first = vectors.agg(F.max(F.size("x")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    dims, n = first["d"] or 0, first["n"]
    if not n:
        return None
    sums = [0] * dims
    wide = vectors.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    for r in wide.collect():  # one number a dimension
        sums[r["place"]] = int(r["s"])
    if not dims:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    centre = np.array([s / n for s in sums])
    basis = np.linalg.qr(spectrum(vectors, dims, block).vectors[:, ::-1])[0]
    _, inner = _moments(vectors, centre, basis)
    values, turn = np.linalg.eigh(inner / n)
    values, components = np.maximum(values[::-1], 0.0), basis @ turn[:, ::-1]
    trace = float(values.sum())
    kept = min(kept, dims)
    components, variances = components[:, :kept], values[:kept]
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    live = variances > 64 * EPS * dims * max(trace, 0.0)
    variances = np.where(live, variances, 0.0)
    error = 0.0
    if live.any():
        mean, square = _moments(vectors, centre, components[:, live] / np.sqrt(variances[live]))
        error = float(np.abs(square / n - np.outer(mean, mean) / n**2 - np.eye(int(live.sum()))).max())
    return Whitening(n, sums, components, variances, variances / trace if trace else variances, error)


OUT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def valid_rows(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows that take part: no null, infinite or undefined entry."""
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), scaled("embedding", scale).alias("x")).where("x is not null")


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per row of ``rows`` and component.

    A shorter vector counts as filled up with zeros. A component without variance has a null ``whitened``; a ``deviation``
    beyond a long is null. Null ids and repeated rows keep their rows; without vectors there are none.
    """
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    n, sums, kept, dims = model.n, model.sums, model.components.shape[1], len(model.sums)
    centre = np.array([s / n for s in sums])
    live = model.variances > 0
    basis = model.components / np.where(live, np.sqrt(np.where(live, model.variances, 1.0)), 1.0)

    def run(batches):
        whole = np.array(sums, dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                x = matrix(part.column(1), dims)
                most = int(np.abs(x.astype(float)).max(initial=0.0)) + 1
                if dims * (n * most + max(map(abs, sums), default=0)) ** 2 < 2**62:
                    gap = n * x - np.array(sums, np.int64)
                    deviation = (gap * gap).sum(axis=1).tolist()
                else:
                    deviation = [int(((n * row - whole) ** 2).sum()) for row in x.astype(object)]
                    deviation = [v if v < 2**63 else None for v in deviation]
                w = (x - centre) @ basis
                count = len(x)
                mask = np.tile(~live, count)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(count), kept))), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), count)), pa.array(np.full(count * kept, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(count), kept))), pa.array(w.reshape(-1), mask=mask), pa.array(np.tile(model.explained, count)),
                    pa.array(np.full(count * kept, model.identity_error))], names=OUT.names)
    return rows.select("vec_id", "x").mapInArrow(run, OUT)


def whiten(table: DataFrame, kept: int = KEPT) -> DataFrame:
    """``table`` (vec_id, embedding) whitened: see ``fit`` and ``transform``."""
    rows = valid_rows(table)
    return transform(rows, fit(rows, kept))
