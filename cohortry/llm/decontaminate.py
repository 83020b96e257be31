"""Benchmark decontamination by a prefix-filtered join of item windows with document words."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from cohortry.llm.common import DataFrame, F, T, materialise, per_slice, plain, sized_slices

WINDOW = 10
BLOCK = 50_000  # windows of one block: what a task holds of the benchmark is bounded, whatever its size

# Everything below 0x80 that is neither a digit nor a letter separates words; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, at, words): every run of ``size`` words of an item; a shorter item is one run, an item
    without words has none. A null id counts as the empty string."""
    out = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("at", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType()))])

    def make():
        def work(part, texts):
            rows = []
            for item, text in zip(part.column(0).to_pylist(), texts):
                w = words_of(text)
                rows += [(item, i, w[i:i + size]) for i in range(max(1, len(w) - size + 1)) if w]
            return [list(c) for c in zip(*rows)] if rows else [[], [], []]
        return work
    return per_slice(plain(items, "item_id", "text").withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), "text", out, make)


def word_counts(docs: DataFrame, vocabulary) -> dict[bytes, int]:
    """Occurrences over all documents of the words of a bounded, broadcast vocabulary."""
    at = docs.columns.index("text")

    def run(batches):
        held = vocabulary.value
        counts = np.zeros(len(held) + 1, np.int64)
        for batch in batches:
            for part in sized_slices(batch, at):
                for t in part.column(at).to_pylist():
                    if t:
                        np.add.at(counts, [held.get(w, -1) for w in words_of(t)], 1)
        some = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])
    rows = docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per word of the vocabulary
    return {r["word"]: r["n"] for r in rows}


def _index(windows: list, rarity: dict[bytes, int]) -> tuple[dict, dict]:
    """Prefix index. A window is contained only if all its words are, so its rarest word is the whole
    prefix that must be joined. rarest word -> {(its place, window length)}; window -> its items."""
    prefix, known = defaultdict(set), defaultdict(set)
    for item, words in windows:
        w = tuple(words)
        j = min(range(len(w)), key=lambda k: (rarity.get(w[k], 0), w[k], k))
        prefix[w[j]].add((j, len(w)))
        known[w].add(item)
    return {k: sorted(v) for k, v in prefix.items()}, {k: sorted(v) for k, v in known.items()}


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``docs`` with __n_words, __n_hit and __items (ids of items with an occurring window).

    The benchmark is taken in blocks of about ``block`` windows, each broadcast on its own; the documents
    stream past each block and gather their hits, so nothing is shuffled and no side is unbounded. With more
    than one block the rows are written between blocks, so a task never runs more than one. Words
    are joined on a window's rarest word (counted over all documents), the place of that word and the
    window's length give the only possible span, and the span is compared word by word. Repeated rows
    and repeated items give the same result for each row; null and empty texts have no words.
    """
    spark = docs.sparkSession
    windows = materialise(item_windows(items, size), "windows")
    blocks = max(1, -(-windows.count() // block))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item_id", "at"), F.lit(blocks)))
    kept = docs.columns
    out = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__spans": F.array().cast("array<bigint>"), "__items": F.array().cast("array<string>")})
    texts = plain(docs, "text")
    for b in range(blocks):
        held = [(r["item_id"], [bytes(w) for w in r["words"]]) for r in windows.where(F.col("block") == b).select("item_id", "words").collect()]
        names = sorted({w for _, words in held for w in words})
        counts = word_counts(texts, spark.sparkContext.broadcast({w: i for i, w in enumerate(names)}))
        index = spark.sparkContext.broadcast(_index(held, {w: counts.get(i, 0) for i, w in enumerate(names)}))
        out = out.mapInArrow(_probe(index, kept.index("text"), len(kept)), out.schema)
        if b + 1 < blocks:
            out = materialise(out, "hits")
    covered = F.size("__spans")
    return out.select(*[F.col(f"`{c}`") for c in kept], "__n_words", covered.cast("long").alias("__n_hit"), F.array_sort(F.array_distinct("__items")).alias("__items"))


def _probe(index, text: int, width: int):
    def run(batches):
        prefix, known = index.value
        for batch in batches:
            for part in sized_slices(batch, text):
                n, spans, items = [], [], []
                for t, old, had in zip(part.column(text).to_pylist(), part.column(width + 1).to_pylist(), part.column(width + 2).to_pylist()):
                    w = words_of(t) if t else []
                    hit, found = set(old), set(had)
                    for i, word in enumerate(w):
                        if word in prefix:
                            for j, length in prefix[word]:
                                s = i - j
                                if s >= 0 and s + length <= len(w) and (got := known.get(tuple(w[s:s + length]))):
                                    hit.update(range(s, s + length))
                                    found.update(got)
                    n.append(len(w))
                    spans.append(sorted(hit))
                    items.append(sorted(found))
                new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *[a.cast(part.schema.field(width + k).type) for k, a in enumerate(new)]], schema=part.schema)
    return run


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``."""
    h = hits(plain(docs, "doc_id", "text"), items)
    return h.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item window, with their columns."""
    return hits(docs, items).where("__n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win, len(list_slice(w, i, i + 9)) AS n
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
