"""Many penalised logistic models in one job a round: one model per (group, part).

A round is one pass: each task adds up, for every model, the gradient and the second derivatives of its rows; the
sums are added per model on the executors, and only they (columns squared per model) reach the driver, which
makes the Newton step. No row is copied per model and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import keyed_md5, uniform

SLICE = 8192
STEPS = 60


def parts_of(key: str, seeds: int, hold_out: float = 0.15, salt: str = "holdout"):
    """Which of the ``seeds`` models a row trains: each leaves out its own keyed share of the rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda s: uniform(keyed_md5(s, salt, F.col(key))) >= hold_out)


@dataclass
class ManyLogits:
    """Coefficients on standardised columns; the last one is the intercept."""

    means: dict[str, np.ndarray]
    scales: dict[str, np.ndarray]
    betas: dict[tuple[str, int], np.ndarray]
    rounds: int = 0
    worst: float = 0.0
    counts: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)


def _blocks(batches, dims: int):
    """(group, y, x, members) of the rows of one group in a slice."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            code = part.column(0).dictionary_encode()
            place = code.indices.to_numpy()
            y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            m = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1).astype(float)
            for i, name in enumerate(code.dictionary.to_pylist()):
                own = place == i
                yield name, y[own], x[own], m[own]


def _summed(rows: DataFrame, make) -> dict:
    """Sums of the arrays that ``make`` gives per (group, part), added on the executors."""
    def local(batches):
        held: dict = {}
        for name, part, values in make(batches):
            held[name, part] = held[name, part] + values if (name, part) in held else values
        if held:
            yield _packed(held)

    def add(batches):
        now, total = None, None
        for batch in batches:
            for name, part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = np.frombuffer(values.as_py())
                if now == (name, part):
                    total = total + got
                else:
                    if now is not None:
                        yield _packed({now: total})
                    now, total = (name, part), got
        if now is not None:
            yield _packed({now: total})
    kind = "grp string, part int, sums binary"
    added = rows.mapInArrow(local, kind).repartition("grp", "part").sortWithinPartitions("grp", "part").mapInArrow(add, kind)
    return {(r["grp"], r["part"]): np.frombuffer(bytes(r["sums"])).copy() for r in added.collect()}  # one row per model


def _packed(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"grp": pa.array([k[0] for k in held], pa.string()), "part": pa.array([k[1] for k in held], pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})


def shaped(rows: DataFrame, group: str, label: str, columns: Sequence[str], members) -> DataFrame:
    """(grp, y, x, members): what the passes read."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return rows.select(F.col(group).cast("string").alias("grp"), F.col(label).cast("double").alias("y"), x.alias("x"), members.alias("members"))


def fit_logits(train: DataFrame, dims: int, c: float = 1.0, tol: float = 1e-9) -> ManyLogits:
    """Models of ``train`` (see ``shaped``), each on the rows of its group that it is a member of. Columns are standardised
    over the group's rows; slopes have the penalty 1 / (2 c) * |b|^2 beside the summed loss, the intercept none. A model whose
    labels are all alike keeps slopes of 0 and the log odds of (positives + 1/2) / (rows + 1)."""
    def moments(batches):
        for name, y, x, m in _blocks(batches, dims):
            yield name, 0, np.concatenate([[len(y)], x.sum(axis=0), np.square(x).sum(axis=0)])
    means, scales = {}, {}
    for (name, _), s in _summed(train, moments).items():
        means[name] = s[1:dims + 1] / s[0]
        sd = np.sqrt(np.maximum(s[dims + 1:] / s[0] - means[name] ** 2, 0.0))
        scales[name] = np.where(sd > 1e-12, sd, 1.0)

    def tally(batches):
        for name, y, x, m in _blocks(batches, dims):
            for k in range(m.shape[1]):
                yield name, k, np.array([m[:, k].sum(), m[:, k] @ y])
    counts = {k: (v[0], v[1]) for k, v in _summed(train, tally).items()}
    model = ManyLogits(means, scales, {k: np.append(np.zeros(dims), np.log((p + 0.5) / (n - p + 0.5))) for k, (n, p) in counts.items()}, counts=counts)
    penalty = np.append(np.full(dims, 1.0 / c), 0.0)
    open_ = {k for k, (n, p) in counts.items() if 0 < p < n}
    before: dict = {}
    for model.rounds in range(1, STEPS + 1):
        if not open_:
            break
        betas, live = dict(model.betas), sorted(open_)

        def derivatives(batches):
            for name, y, x, m in _blocks(batches, dims):
                z = np.column_stack([(x - means[name]) / scales[name], np.ones(len(y))])
                for g, k in live:
                    if g == name:
                        t = z @ betas[g, k]
                        p = 1 / (1 + np.exp(-t))
                        w = m[:, k]
                        loss = (w * (np.logaddexp(0, t) - y * t)).sum()
                        yield g, k, np.concatenate([[loss], z.T @ (w * (y - p)), (z.T @ (z * (w * p * (1 - p))[:, None])).reshape(-1)])
        sums = _summed(train, derivatives)
        model.worst = 0.0
        for k in live:
            s, b = sums[k], model.betas[k]
            loss = s[0] + (penalty * b * b).sum() / 2
            if k in before and loss > before[k][0] + 1e-12 * abs(before[k][0]):  # too far: half the step back
                model.betas[k] = (b + before[k][1]) / 2
                model.worst = np.inf
                continue
            slope = s[1:dims + 2] - penalty * b
            size = float(np.abs(slope).max()) / max(1.0, counts[k][0])
            model.worst = max(model.worst, size)
            if size <= tol:
                open_.discard(k)
            else:
                before[k] = (loss, b)
                model.betas[k] = b + np.linalg.solve(s[dims + 2:].reshape(dims + 1, dims + 1) + np.diag(penalty + 1e-12), slope)
    if open_:
        raise RuntimeError(f"{len(open_)} models did not settle")
    return model


def predicted(rows: DataFrame, model: ManyLogits, keep: Sequence[str], dims: int) -> DataFrame:
    """``keep``, part and the probability, one row per row and model of its group. ``rows`` has grp, x and the kept
    columns; a row of a group without models gives none."""
    kinds = dict(rows.dtypes)
    parts = {g: sorted(k for h, k in model.betas if h == g) for g, _ in model.betas}
    means, scales, betas = model.means, model.scales, model.betas

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names = np.array(part.column(0).to_pylist(), object)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                for name in dict.fromkeys(names.tolist()):
                    if name not in parts:
                        continue
                    own = np.flatnonzero(names == name)
                    z = np.column_stack([(x[own] - means[name]) / scales[name], np.ones(len(own))])
                    p = 1 / (1 + np.exp(-z @ np.column_stack([betas[name, k] for k in parts[name]])))
                    n = len(parts[name])
                    held = part.take(pa.array(np.repeat(own, n)))
                    yield pa.RecordBatch.from_arrays([*[held.column(2 + i) for i in range(len(keep))], pa.array(np.tile(np.array(parts[name], np.int32), len(own))), pa.array(p.reshape(-1))], names=[*keep, "part", "score"])
    out = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", part int, score double"
    return rows.select("grp", "x", *keep).mapInArrow(run, out)
