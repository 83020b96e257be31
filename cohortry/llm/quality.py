"""Quality rules: whole-text statistics and a learned decision list over them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd

from cohortry.llm.common import DataFrame, F, T, hash_sample, per_slice, plain

# Characters that count as symbols, and the blanks between words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_bangs", "n_digits", "n_lines"]
#: What the rules may test: name -> (numerator, denominator).
FEATURES = {
    "words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "distinct": ("n_distinct_words", "n_words"), "upper": ("n_upper", "word_chars"), "bangs": ("n_bangs", "n_words"), "digits": ("n_digits", "word_chars"), "line_words": ("n_words", "n_lines")}


def count_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts of :data:`COUNTS` for every text, over a bounded list of texts at a time.

    Words are runs of non-blanks. A word repeats if it lies in a window of eight words found twice or more
    in its text: windows get exact ids by doubling (pairs of words, of pairs, of quadruples).
    """
    m = len(texts)
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    out = {k: np.zeros(m, np.int64) for k in COUNTS}
    out["n_words"] = n
    for i, t in enumerate(texts):
        out["word_chars"][i] = len(t) - sum(map(t.count, BLANKS))
        out["n_symbols"][i] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_bangs"][i] = t.count("!")
        b = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        out["n_upper"][i] = np.count_nonzero((b >= 65) & (b <= 90))
        out["n_digits"][i] = np.count_nonzero((b >= 48) & (b <= 57))
    total = int(n.sum())
    if not total:
        return out
    doc = np.repeat(np.arange(m), n)
    ids = pd.factorize(np.array(list(chain.from_iterable(words)), object))[0].astype(np.int64)
    seen = pd.factorize(doc * (total + 1) + ids)[0]
    new = np.ones(total, bool)
    new[1:] = seen[1:] > np.maximum.accumulate(seen)[:-1]
    out["n_distinct_words"] = np.bincount(doc[new], minlength=m)
    width, at = 1, ids
    while width < WINDOW:
        at = pd.factorize(at[:-width] * (total + 1) + at[width:])[0].astype(np.int64) if len(at) > width else at[:0]
        width *= 2
    ends = np.cumsum(n)[doc]
    starts = np.flatnonzero(np.arange(len(at)) + WINDOW <= ends[:len(at)])
    if len(starts):
        key = pd.factorize(doc[starts] * (total + 1) + at[starts])[0]
        twice = starts[np.bincount(key)[key] > 1]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        out["n_repeat_words"] = np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=m)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, counts): one row per row of ``docs``; a null text has no words."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def make():
        def work(part, texts):
            c = count_texts(texts)
            return [part.column(0), *[c[k].astype(np.int64) for k in COUNTS]]
        return work
    return per_slice(plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "text", out, make)


def feature(name: str) -> F.Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> F.Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


Rule = tuple  # of Tests that hold together: the row is low quality


def _cover(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, [t.holds(x) for t in rule], np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int, steps: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(y), bool)
    while len(rule) < longest:
        p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
        if not n0 or not p0:
            break
        best, gained = None, 0.0
        for name, values in x.items():
            v = values[inside]
            for threshold in np.unique(np.quantile(v, np.linspace(0, 1, steps + 1)[1:-1])):
                for above in (True, False):
                    hit = v > threshold if above else v <= threshold
                    p, n = int((hit & y[inside]).sum()), int((hit & ~y[inside]).sum())
                    gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))) if p else 0.0
                    if gain > gained + 1e-9:
                        best, gained = Test(name, above, float(threshold)), gain
        if best is None:
            break
        rule = (*rule, best)
        inside &= best.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, fold: np.ndarray, precision: float = 0.95, least: int = 5, longest: int = 4, most_rules: int = 16, steps: int = 64) -> list[Rule]:
    """A decision list for low-quality rows by sequential covering.

    Each rule is grown on two thirds of the rows (``fold`` not 0) by information gain, its last tests are
    pruned where that does not lower its worth on the other third, and it is kept if it is right there for
    a share of ``precision`` of at least ``least`` rows. Rows it covers leave the set.
    """
    rules, left = [], np.ones(len(low), bool)
    for _ in range(most_rules):
        grow, prune = left & (fold != 0), left & (fold == 0)
        if low[grow].sum() < least or low[prune].sum() < least:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, low[grow], longest, steps)
        xp, yp = {k: v[prune] for k, v in x.items()}, low[prune]

        def worth(r: Rule) -> tuple[float, float, int]:
            c = _cover(r, xp, len(yp))
            p, n = int((c & yp).sum()), int((c & ~yp).sum())
            return (p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0, p
        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule = rule[:-1]
        if not rule or worth(rule)[1] < precision or worth(rule)[2] < least:
            break
        rules.append(rule)
        left &= ~_cover(rule, x, len(low))
    return rules


def fit(stats: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    """Learn from at most ``most`` labelled documents, those with the smallest hash of their id. Rows with a
    null id or label are not used; without both classes the list is empty and keeps everything."""
    named = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_low"))
    joined = stats.join(named, F.col("doc_id") == F.col("_id")).select("_id", "_low", *[feature(f).alias(f) for f in FEATURES])
    rows = hash_sample(joined, ["_id"], most).toPandas()
    if rows["_low"].nunique() < 2:
        return []
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, rows["_low"].to_numpy(bool), (np.arange(len(rows)) % 3).astype(int))


def decide(rules: list[Rule]) -> F.Column:
    """The list as one conditional expression: the first rule that holds rejects; else the row stays."""
    out = None
    for rule in rules:
        holds = reduce(lambda a, b: a & b, [t.column() for t in rule])
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept. Empty texts fail the base; an empty table gives no rows."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & decide(rules))
