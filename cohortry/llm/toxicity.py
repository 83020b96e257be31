"""Toxicity by compression distance: dictionaries trained on toxic and on ordinary text, window by window.

A window is a word with the blanks around it. It is compressed once with a dictionary of toxic text and
once with one of ordinary text; the difference of the two lengths says which text it comes from. The
differences of a whole text give a few figures, and a logistic curve over them is calibrated on documents
that the dictionaries were not trained on.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from cohortry.llm.common import DataFrame, F, T, hash_sample, per_slice, plain, sized_slices

SAMPLE = 5_000           # labelled documents a model is fitted on, at most
TOXIC_BYTES, ORDINARY_BYTES = 2048, 112_640
LEVEL = 6
CONTRAST = 20.0          # how much likelier in toxic than in ordinary documents what the toxic dictionary is trained on
HELD = 1_000_000          # windows whose difference a worker remembers
FOLDS = 3                # pairs of dictionaries: each is calibrated on the third of the documents that it has not seen

# Padding that both dictionaries hold: the compressor leaves short inputs and the last bytes of any input alone.
_HEAD = bytes(random.Random(5).choices(range(33, 127), k=48))
_TAIL = bytes(random.Random(9).choices(range(33, 127), k=24))


def windows(text: str) -> list[str]:
    return text.lower().split()


@dataclass(frozen=True)
class Part:
    toxic: bytes
    ordinary: bytes
    mean: tuple
    scale: tuple
    weights: tuple  # the last is the constant


@dataclass(frozen=True)
class Model:
    parts: tuple  # one for each fold; a text's log odds are their mean


class Meter:
    """Length with the ordinary dictionary less length with the toxic one, per window, and 0 where that is
    negative. A window that the toxic dictionary cannot shorten is at most as long with the other one, so
    it is not compressed again."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by_toxic, self.by_ordinary = _compressor(toxic), _compressor(ordinary)
        strange = bytes(random.Random(3).choices(range(1, 32), k=12))
        self.frame = len(self.by_toxic.compress(b"%s %s %s" % (_HEAD, strange, _TAIL))) - len(strange)

    def difference(self, window: bytes) -> int:
        b = b"%s %s %s" % (_HEAD, window, _TAIL)
        n = len(self.by_toxic.compress(b))
        return max(0, len(self.by_ordinary.compress(b)) - n) if n < len(window) + self.frame else 0


class Meters:
    """Several meters over the same windows; the differences of a window are remembered together."""

    def __init__(self, meters: list[Meter]):
        self.meters, self.known = meters, {}

    def differences(self, window: str) -> tuple:
        if len(self.known) >= HELD:
            self.known.clear()
        w = window.encode("utf-8", "surrogatepass")
        d = self.known[window] = tuple(m.difference(w) for m in self.meters)
        return d

    def figures(self, text: str) -> np.ndarray:
        """A row per meter: the largest differences, and how often they occur. The four largest differ between
        windows, so one word said often counts once among them."""
        kinds = Counter(windows(text))
        if not kinds:
            return np.zeros((len(self.meters), 7))
        known = self.known
        d = np.array([known.get(w) or self.differences(w) for w in kinds], float)
        n = np.fromiter(kinds.values(), float, len(kinds))
        top = np.sort(d, axis=0)[::-1][:4]
        share = [n @ (d >= k) / n.sum() for k in (1, 2, 3)]
        return np.column_stack([top[0], top[:2].mean(axis=0), top.mean(axis=0), share[0], share[1] ** 0.5, share[2] ** 0.5, np.log1p(n @ (d >= 2))])


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content + _TAIL + _HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(pieces: list[str], size: int, rng: random.Random) -> bytes:
    """Content that the trainer picks from the pieces, in samples of eight; with too few of them, the
    pieces themselves."""
    rng.shuffle(pieces)
    samples = [b"".join(b" %s " % p.encode("utf-8", "surrogatepass") for p in pieces[i:i + 8]) for i in range(0, len(pieces), 8)]
    try:
        return zstandard.train_dictionary(size, samples, k=48, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fold_of(text: str) -> int:
    """The fold of a text depends on the text alone, so the order of the rows changes nothing."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=FOLDS) % FOLDS


def train(texts: list[str], toxic: list[bool]) -> Model | None:
    """Fit on whole texts. Copies count once. Every fold's dictionaries are trained on the other folds and calibrated
    on it, so all documents serve for both. None without both classes."""
    rows = sorted({t: y for t, y in sorted(zip(texts, toxic))}.items())
    folds = [fold_of(t) for t, _ in rows]
    parts = [_part([r for r, f in zip(rows, folds) if f != k], [r for r, f in zip(rows, folds) if f == k]) for k in range(FOLDS)]
    parts = [p for p in parts if p is not None]
    return Model(tuple(parts)) if parts else None


def _part(fit: list[tuple[str, bool]], rest: list[tuple[str, bool]]) -> Part | None:
    rng = random.Random(0)
    if len({y for _, y in fit}) < 2 or len({y for _, y in rest}) < 2:
        return None
    in_docs = {True: Counter(), False: Counter()}
    for t, y in fit:
        in_docs[y].update(set(windows(t)))
    n = Counter(y for _, y in fit)
    own = {w for w, k in in_docs[True].items() if k >= 2 and (k / n[True]) / ((in_docs[False][w] + 1) / n[False]) >= min(CONTRAST, n[False] * 3 / n[True] / 2)}
    toxic_words = [w for t, y in fit if y for w in windows(t) if w in own]
    share = 220_000 / max(1, sum(len(windows(t)) for t, y in fit if not y))
    ordinary_words = [w for t, y in fit if not y for w in windows(t) if rng.random() < share]
    rng.shuffle(ordinary_words)
    first, second = _dictionary(toxic_words, TOXIC_BYTES, rng), _dictionary(ordinary_words[:200_000], ORDINARY_BYTES, rng)
    meters = Meters([Meter(first, second)])
    x = np.array([meters.figures(t)[0] for t, _ in rest])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w = _logistic(np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.array([y for _, y in rest], float))
    return Part(first, second, tuple(mean), tuple(scale), tuple(w))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """A model from at most ``most`` labelled documents, those with the smallest hash of their id, none of
    them held out. Rows with a null id, label or text are not used."""
    named = (labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).alias("_toxic"))
             .where(~held_out(F.col("_id"))))
    named = hash_sample(named, ["_id"], most)
    rows = plain(docs, "doc_id", "text").join(F.broadcast(named), F.col("doc_id") == F.col("_id")).where("text is not null").orderBy("_id").select("text", "_toxic").collect()
    return train([r["text"] for r in rows], [r["_toxic"] for r in rows])


@lru_cache(maxsize=2)
def _meters(m: Model) -> Meters:
    """The meters of a model, once per worker process."""
    return Meters([Meter(p.toxic, p.ordinary) for p in m.parts])


def _logits(m: Model, meters: Meters, texts: list[str]) -> np.ndarray:
    x = np.array([meters.figures(t) for t in texts]).reshape(len(texts), len(m.parts), 7)
    total = np.zeros(len(texts))
    for i, part in enumerate(m.parts):
        total += (x[:, i] - part.mean) / part.scale @ np.array(part.weights[:-1]) + part.weights[-1]
    return total / len(m.parts)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``; null and empty texts have the
    score of no windows. Without a model every score is 0."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        if m is None:
            return lambda part, texts: [part.column(0), [0.0] * len(texts)]
        meters = _meters(m)

        def work(part, texts):
            return [part.column(0), 1 / (1 + np.exp(-np.clip(_logits(m, meters, texts), -30, 30)))]
        return work
    rows = per_slice(plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "text", out, make)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = sent.value
        meters = m and _meters(m)
        for batch in batches:
            for part in [batch] if m is None else sized_slices(batch, at):
                if m is not None:
                    part = part.filter(pa.array(_logits(m, meters, [t or "" for t in part.column(at).to_pylist()]) < 0))
                yield part
    return docs.mapInArrow(run, docs.schema)
