"""Near-duplicate paragraphs: MinHash bands, exact Jaccard on what collides, components, removal; and passages that
repeat anywhere in the texts, found by the local minima of shingle hashes."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

from cohortry.llm.common import DataFrame, F, T, bit_map, materialise, per_slice, plain, row_key
from cohortry.operators.graph import components

SHINGLE = 5
ROWS = 4
LEAST_WORDS = 30
MOST = 2000  # paragraphs one task compares with each other at a time
SPAN = 40  # words of a passage under test
REACH = 2  # a passage begins where a shingle's hash is the smallest of so many on either side
ANCHOR = 3  # words of such a shingle


def tune_bands(similarity: float, recall: float = 0.999, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes needed for a pair at ``similarity`` to collide with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def split(text: str, least: int) -> list[tuple[int, list[bytes]]]:
    """(place, words) of the paragraphs (lines) of at least ``least`` words; A-Z are lower-cased."""
    out = []
    for i, p in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
        w = p.split()
        if len(w) >= least:
            out.append((i, w))
    return out


def shingles(words: list[bytes]) -> list[bytes]:
    return list(map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)]))) if len(words) >= SHINGLE else [b" ".join(words)]


def name_of(words: list[bytes]) -> str:
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


class Bands:
    def __init__(self, bands: int):
        rng = np.random.default_rng(11)
        self.bands, k = bands, bands * ROWS
        self.a = rng.integers(1, 2**32, k, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, k, dtype=np.uint32)
        self.mix = rng.integers(1, 2**63, (bands, ROWS), dtype=np.uint64) | np.uint64(1)

    def keys(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        """(paragraphs, bands) band keys as signed longs; the band is part of the key."""
        out, at = np.empty((len(paragraphs), self.bands), np.int64), 0
        while at < len(paragraphs):
            held, stop, n = [], at, 0
            while stop < len(paragraphs) and (not held or n < 8192):
                s = shingles(paragraphs[stop])
                held.append(np.fromiter(map(xxhash.xxh3_64_intdigest, s, repeat(5)), np.uint64, len(s)))
                n, stop = n + len(s), stop + 1
            h = np.concatenate(held)
            h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
            low = np.minimum.reduceat(h[:, None] * self.a + self.b, np.cumsum([0, *map(len, held)])[:-1], axis=0)
            m = (low.astype(np.uint64).reshape(len(held), self.bands, ROWS) * self.mix).sum(axis=2, dtype=np.uint64)
            m = (m ^ (m >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out[at:stop] = (m ^ (m >> np.uint64(29))).view(np.int64)
            at = stop
        return out


def occurrences(docs: DataFrame, least: int, bands: int) -> DataFrame:
    """(doc_id, row, paragraph, n_words, name, keys): one row per paragraph under test."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("paragraph", T.LongType()), T.StructField("n_words", T.LongType()),
                        T.StructField("name", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def make():
        hashing = Bands(bands)

        def work(part, texts):
            rows = [(d, r, i, w) for d, r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts) for i, w in split(t, least)]
            keys = hashing.keys([r[3] for r in rows])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            return [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [len(r[3]) for r in rows], [name_of(r[3]) for r in rows], flat]
        return work
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return per_slice(rows, "text", out, make)


def _bodies(docs: DataFrame, least: int, wanted) -> DataFrame:
    """(name, body) of the paragraphs whose name is marked in the broadcast map."""
    out = T.StructType([T.StructField("name", T.StringType()), T.StructField("body", T.BinaryType())])

    def make():
        held = wanted.value

        def work(part, texts):
            got = {}
            for t in texts:
                for _, w in split(t, least):
                    n = name_of(w)
                    if held.has(int(n[:15], 16)):
                        got[n] = b" ".join(w)
            return [list(got), list(got.values())]
        return work
    return per_slice(plain(docs, "text"), "text", out, make).groupBy("name").agg(F.first("body").alias("body"))


def verified_links(candidates: DataFrame, similarity: float, most: int = MOST) -> DataFrame:
    """(src, dst) that join all paragraphs of a bucket linked by exact Jaccard similarity.

    ``candidates`` has key, name, body and n (the bucket's size). A bucket of more than ``most`` is cut into
    slices, and each two slices meet in a part of their own, so no part exceeds 2 * ``most``. In a
    part, what is linked to a group already found is not compared again.
    """
    slices = F.ceil(F.col("n") / most).cast("int")
    mine = F.pmod(F.xxhash64("name"), slices)
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, mine.cast("int")).alias("p"), F.greatest(o, mine.cast("int")).alias("q")))
    parts = candidates.select("key", "name", "body", F.explode(pairs).alias("s")).select("key", "s.p", "s.q", "name", "body")
    dealt = parts.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "name")

    def run(batches):
        now, names, sets = None, [], []
        for batch in batches:
            for key, p, q, name, body in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (key, p, q) != now:
                    yield from _forest(names, sets, similarity)
                    now, names, sets = (key, p, q), [], []
                names.append(name)
                sets.append(frozenset(shingles(body.split(b" "))))
        yield from _forest(names, sets, similarity)
    return dealt.mapInArrow(run, "src string, dst string").distinct()


def _forest(names: list[str], sets: list[frozenset], similarity: float):
    left, out = list(range(len(names))), []
    while left:
        todo, left = [left[0]], left[1:]
        while todo and left:
            at, rest = todo.pop(), []
            a = sets[at]
            for x in left:
                b = sets[x]
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and (both := len(a & b)) >= similarity * (len(a) + len(b) - both):
                    out.append((names[at], names[x]))
                    todo.append(x)
                else:
                    rest.append(x)
            left = rest
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out])], names=["src", "dst"])


def clusters(docs: DataFrame, similarity: float = 0.8, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, row, paragraph, n_words, cluster_id, cluster_size, kept): the paragraphs of at least ``least``
    words that have an equal or near-equal one; the first of a cluster by id, then place, is kept.

    Equal paragraphs are folded to one name before bands are compared. Band keys that occur once are left
    out by a map of fixed size. Null and empty texts have no paragraphs; a repeated row shares the fate of
    its twin; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bands = tune_bands(similarity)
    occ = materialise(occurrences(docs, least, bands), "paragraphs")
    folded = materialise(occ.groupBy("name").agg(F.first("keys").alias("keys")), "folded")
    shared = folded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(shared, "buckets")
    marks = spark.sparkContext.broadcast(bit_map(shared, F.col("key")))

    def marked(batches):
        held = marks.value
        for batch in batches:
            keys = batch.column(1).flatten().to_numpy()
            hit = held.have(keys)
            names = np.repeat(np.arange(batch.num_rows), bands)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), batch.column(0).take(pa.array(names))], names=["key", "name"])
    members = materialise(folded.select("name", "keys").mapInArrow(marked, "key long, name string").join(shared, "key"), "members")
    names = members.select("name").distinct()
    wanted = spark.sparkContext.broadcast(bit_map(names, F.conv(F.substring("name", 1, 15), 16, 10).cast("long")))
    bodies = materialise(_bodies(docs, least, wanted), "bodies")
    links = materialise(verified_links(members.join(bodies, "name"), similarity), "links")  # read twice below
    near = materialise(components(links), "near")
    slim = occ.select("doc_id", "row", "paragraph", "n_words", "name").join(near, occ.name == near.node, "left").withColumn("cluster_id", F.coalesce("component", "name"))
    slim = materialise(slim.select("doc_id", "row", "paragraph", "n_words", "cluster_id"), "clustered")
    place = F.struct("doc_id", "row", "paragraph")
    sizes = slim.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(place).alias("first")).where("cluster_size > 1")
    return slim.join(sizes, "cluster_id").select("doc_id", "row", "paragraph", "n_words", "cluster_id", "cluster_size", (place == F.col("first")).alias("kept"))


def remove(docs: DataFrame, similarity: float = 0.8, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with text without the paragraphs that are not kept."""
    gone = clusters(docs, similarity, least).where("not kept").groupBy(F.col("doc_id").alias("__d"), F.col("row").alias("__r")).agg(F.collect_set(F.col("paragraph").cast("int")).alias("__gone"))
    both = docs.withColumn("__row", row_key()).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return both.select(*[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns])


def anchors(words: list[bytes]) -> np.ndarray:
    """Places of the words where a passage under test begins: the shingle of ANCHOR words there has the smallest hash
    within REACH places. The choice depends on the words around alone, so a repeated run of 51 words has such a place in
    its first 12 but for rare cases, whatever stands before it and however its lines are broken."""
    n = len(words) - ANCHOR + 1
    if len(words) < SPAN:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(7)), np.uint64, len(words))
    h = ids[:n].copy()
    for j in range(1, ANCHOR):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j:n + j]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(30)
    low, edge = h.copy(), np.uint64(2**64 - 1)
    for j in range(1, REACH + 1):
        low[j:] = np.minimum(low[j:], h[:-j] if n > j else edge)
        low[:-j] = np.minimum(low[:-j], h[j:] if n > j else edge)
    return np.flatnonzero(h[:len(words) - SPAN + 1] == low[:len(words) - SPAN + 1])


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, word, n_words, cluster_id, cluster_size, kept): the passages of SPAN words, across lines and
    inside them, that stand in more than one document; ``paragraph`` is the line and ``word`` the place where it
    begins, the first of a cluster by id, then place, is kept. A passage counts once in a document. Equal means equal
    words with A-Z lower-cased, by a hash of 128 bits. Passages that occur once are left out by a map of fixed size."""
    spark = docs.sparkSession
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("row", "paragraph", "word", "h", "g")]])

    def make():
        def work(part, texts):
            counts, lines, places, names = [], [], [], []
            for t in texts:
                words, starts = [], []
                for line in t.encode("utf-8", "surrogatepass").lower().split(b"\n"):
                    starts.append(len(words))
                    words += line.split()
                at = anchors(words)
                if len(at):
                    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                    begins = np.where(at > 0, ends[at - 1], 0)
                    own = [xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(begins.tolist(), (ends[at + SPAN - 1] - 1).tolist())]
                    if len(first := dict(zip(reversed(own), range(len(own) - 1, -1, -1)))) < len(own):  # the first place of each
                        at, own = at[list(first.values())], list(first)
                    lines.append(np.searchsorted(starts, at, side="right") - 1)
                    places.append(at)
                    names += own
                counts.append(len(at))
            hashes = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2)
            ids = pa.array(np.repeat(np.arange(len(counts)), counts))
            none = [np.zeros(0, np.int64)]
            return [part.column(0).take(ids), part.column(1).take(ids), pa.array(np.concatenate(none + lines)), pa.array(np.concatenate(none + places)), *map(pa.array, np.ascontiguousarray(hashes.T))]
        return work
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    found = materialise(per_slice(rows, "text", out, make), "passages")
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marks = spark.sparkContext.broadcast(bit_map(twice, F.col("h")))

    def marked(batches):
        for batch in batches:
            yield batch.filter(pa.array(marks.value.have(batch.column(4).to_numpy())))
    some = found.mapInArrow(marked, out)
    place = F.struct("doc_id", "row", "word")
    shared = some.groupBy("h", "g").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(place).alias("first"), F.max(F.struct("doc_id", "row")).alias("_last"))
    shared = shared.where("NOT (struct(first.doc_id AS doc_id, first.row AS row) <=> _last)").drop("_last")
    name = F.lower(F.concat(F.lpad(F.hex("h"), 16, "0"), F.lpad(F.hex("g"), 16, "0")))
    return some.join(shared, ["h", "g"]).select(
        "doc_id", "row", "paragraph", "word", F.lit(SPAN).cast("long").alias("n_words"), name.alias("cluster_id"), "cluster_size", place.eqNullSafe(F.col("first")).alias("kept"))
