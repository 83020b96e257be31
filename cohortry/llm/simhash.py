"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components."""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash

from cohortry.llm.common import DataFrame, F, T, bit_map, materialise, per_slice, plain, row_key
from cohortry.operators.graph import components

BITS = 64


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingle hashes, as an unsigned number; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and only the six ASCII blanks
    if not words:
        return 0
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 65536):
        ones += np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``, fp as a signed long. A null text has no words."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def make():
        def work(part, texts):
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            return [part.column(0), pa.array(fp)]
        return work
    return per_slice(plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "text", out, make)


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` nearly equal groups of the given bit places."""
    return [sum(1 << b for b in bits[len(bits) * i // parts:len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _keys(parts: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` of the ``parts`` blocks of a fingerprint."""
    return [sum(c) for c in combinations(_blocks(list(range(BITS)), parts), agree)]


def links(fps: DataFrame, distance: int = 3, parts: int = 6, most: int = 4096) -> DataFrame:
    """(src, dst): links between distinct fingerprints at ``distance`` bits or fewer that join all of each
    linked group (a spanning forest per bucket; the pairs it leaves out lie inside a group anyway).

    ``parts - distance`` of ``parts`` blocks of two near fingerprints agree, so every choice of that many
    blocks is one key. A bucket of more than ``most`` fingerprints is cut again: the bits its key leaves
    free are split into blocks of four, and all but ``distance`` of those agree too, which leaves at most
    4 * distance free bits. A bucket therefore never holds more than max(most, 2 ** (4 * distance))
    fingerprints, and no pair is lost.
    """
    keys = _keys(parts, parts - distance)
    masks = F.array(*[F.lit(_signed(m)) for m in keys])
    rows = (fps.select("fp", F.posexplode(masks).alias("choice", "mask"))
            .select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key")))
    counts = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(rows.join(counts, ["choice", "key"]), "blocks")
    small = shared.where(F.col("n") <= most).select("choice", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("rest"), "key", "fp")

    def finer(mask: int) -> list[int]:
        free = [b for b in range(BITS) if not mask >> b & 1]
        cells = _blocks(free, max(distance + 1, -(-len(free) // 4)))
        return [_signed(sum(c)) for c in combinations(cells, len(cells) - distance)]
    subs = F.array(*[F.array(*[F.lit(m) for m in finer(k)]) for k in keys])
    large = (shared.where(F.col("n") > most)
             .select("choice", "key", "fp", F.posexplode(F.element_at(subs, F.col("choice") + 1)).alias("sub", "_m"))
             .select("choice", (F.col("sub") + 1).alias("sub"), F.col("fp").bitwiseAND(F.col("_m")).alias("rest"), "key", "fp"))
    by = ["choice", "sub", "key", "rest"]
    dealt = small.unionByName(large).repartition(*by).sortWithinPartitions(*by, "fp")

    def run(batches):
        held = None
        for batch in batches:
            a = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2, 3, 4)])
            a = a if held is None else np.concatenate([held, a])
            cut = np.flatnonzero((a[1:, :4] != a[:-1, :4]).any(axis=1)) + 1
            ends = cut.tolist()
            for s, e in zip([0, *ends], ends):
                yield from _forest(a[s:e, 4], distance)
            held = a[ends[-1] if ends else 0:]
        if held is not None and len(held):
            yield from _forest(held[:, 4], distance)
    found = dealt.select("choice", "sub", "rest", "key", "fp").mapInArrow(run, "src long, dst long")
    return found.distinct()


def _forest(fps: np.ndarray, distance: int):
    """Links that join each group of near fingerprints of one bucket."""
    left, out = np.unique(fps).view(np.uint64), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                new = left[near]
                out += [(int(at), int(x)) for x in new]
                todo += list(new)
                left = left[~near]
    if out:
        a = np.array(out, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["src", "dst"])


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the component is the smallest doc_id reachable over links.

    Equal fingerprints are folded before any join, so copies cost one row. Null or empty texts have
    fingerprint 0 and link to each other. A repeated row gives a repeated result row. Ids that are null
    never name a component; a component with no id at all has null. An empty table gives no rows.
    """
    marks = materialise(fingerprints(docs, shingle), "fingerprints")
    folded = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "folded")
    near = materialise(components(links(folded.select("fp"), distance)), "near")
    low = (near.join(folded, near.node == folded.fp).groupBy("component").agg(F.min("first").alias("low"))
           .withColumnRenamed("component", "_c"))
    named = near.join(low, near.component == low["_c"]).select(F.col("node").alias("fp"), "low")
    home = folded.join(named, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return marks.join(home, "fp").select("doc_id", "fp", "component_id")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


LONG = 4          # 64-bit words of a long fingerprint
RECALL = 0.99     # chance that a pair at the wanted similarity becomes a candidate
WIDE = 4          # deviations above the expected distance up to which a pair is a candidate
MOST = 4096       # fingerprints one task compares with each other at a time
MOST_WORDS = 4_000_000  # words of texts one task compares with each other at a time


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The set of shingles, as sorted distinct 64-bit hashes; none for a text without words."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, max(1, len(words) - shingle + 1)))


def long_fingerprint(words: list[bytes], shingle: int = 5) -> bytes:
    """A SimHash of 64 * LONG bits over the set of word shingles; all zeros without words."""
    h = _shingle_hashes(words, shingle)
    n = len(h)
    if not n:
        return bytes(8 * LONG)
    ones = np.zeros(BITS * LONG, np.int64)
    for i in range(0, n, 16384):
        part = h[i:i + 16384]
        wide = np.column_stack([_mix(part, k) for k in range(LONG)])
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << BITS))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def differing(similarity: float) -> float:
    """Expected share of differing bits of two texts with this Jaccard similarity of their shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def candidate_recall(similarity: float, width: int, blocks: int, distance: int) -> float:
    """Chance that a pair at this similarity shares one of the blocks and is not farther than ``distance``:
    the blocks are chosen from the same bits, so the chance is taken at each distance and then averaged."""
    bits, p = BITS * LONG, differing(similarity)
    return sum(math.comb(bits, d) * p ** d * (1 - p) ** (bits - d) * (1 - (1 - math.comb(bits - d, width) / math.comb(bits, width)) ** blocks) for d in range(distance + 1))


def _choices(n: int, similarity: float) -> tuple[np.ndarray, int]:
    """Bit places of the blocks, and the distance up to which fingerprints are candidates. A block has six
    bits less than log2(n), so chance meetings grow with the input and not with its square; there are as
    many blocks as the recall asks, and the distance is WIDE deviations above what the similarity lets expect."""
    width = max(8, math.ceil(math.log2(max(2, n))) - 6)
    bits, p = BITS * LONG, differing(similarity)
    distance = math.ceil(bits * p + WIDE * math.sqrt(bits * p * (1 - p)))
    blocks = 1
    while candidate_recall(similarity, width, blocks, distance) < RECALL:
        blocks += 1
    rng = np.random.default_rng(17)
    return np.array([rng.permutation(bits)[:width] for _ in range(blocks)]), distance


def long_links(fps: DataFrame, similarity: float, most: int = MOST) -> DataFrame:
    """(src, dst): links that join each group of long fingerprints that may be as near as ``similarity``.

    Close pairs share a block of chosen bits and meet there; their Hamming distance over all bits makes them
    candidates, wide enough to lose next to none. A
    block value shared by more than ``most`` fingerprints is cut into slices, and each two slices meet in a
    part of their own.
    """
    spots, distance = _choices(fps.count(), similarity)
    powers = (1 << np.arange(spots.shape[1], dtype=np.int64))

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(at, 4096)
                bits = np.unpackbits(np.frombuffer(b"".join(part.to_pylist()), np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
                keys = np.column_stack([bits[:, s].astype(np.int64) @ powers + (np.int64(i) << np.int64(40)) for i, s in enumerate(spots)])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), part.take(pa.array(np.repeat(np.arange(len(part)), len(spots))))], names=["key", "fp"])
    rows = fps.select("fp").mapInArrow(blocks, "key long, fp binary")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    slices = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), slices).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, mine).alias("p"), F.greatest(o, mine).alias("q")))
    parts = rows.join(large, "key", "left").select("key", F.explode(pairs).alias("s"), "fp").select("key", "s.p", "s.q", "fp")
    dealt = parts.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches):
        held_keys, held = None, None
        for batch in batches:
            k = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            f = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, LONG)
            if held is not None:
                k, f = np.concatenate([held_keys, k]), np.concatenate([held, f])
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield _pairs(_bucket_links(f[:last], np.concatenate([[0], cut]) if last else np.zeros(1, np.int64), distance))
            held_keys, held = k[last:], f[last:]
        if held is not None:
            yield _pairs(_bucket_links(held, np.array([0, len(held)]), distance))
    return dealt.mapInArrow(run, "src binary, dst binary").distinct()


FEW = 128  # buckets up to this size are compared all together


def _bucket_links(fps: np.ndarray, ends: np.ndarray, distance: int) -> list[tuple[bytes, bytes]]:
    """Links that join what is near inside each bucket; ``ends`` has the bounds of the buckets. Small buckets
    are compared at once, row against row one, two, ... places on."""
    size = np.diff(ends)
    left = np.repeat(np.where(size <= FEW, ends[1:], 0), size) - np.arange(len(fps))  # rows from here to the end of a small bucket
    out: list[tuple[bytes, bytes]] = []
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := group.get(x, x)) != x:
            group[x] = x = group.get(up, up)
        return x
    at = np.arange(len(fps))
    for step in range(1, FEW):
        at = at[left[at] > step]
        if not len(at):
            break
        for x in at[np.bitwise_count(fps[at] ^ fps[at + step]).sum(axis=1) <= distance].tolist():
            a, b = root(x), root(x + step)
            if a != b:
                group[b] = a
                out.append((fps[x].tobytes(), fps[x + step].tobytes()))
    for s, e in zip(ends[:-1][size > FEW].tolist(), ends[1:][size > FEW].tolist()):
        out += _long_forest(fps[s:e], distance)
    return out


def _pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["src", "dst"])


def _long_forest(fps: np.ndarray, distance: int) -> list[tuple[bytes, bytes]]:
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1) <= distance
            if near.any():
                out += [(fps[at].tobytes(), fps[x].tobytes()) for x in left[near]]
                todo += left[near].tolist()
                left = left[~near]
    return out


def verified_links(candidates: DataFrame, similarity: float, shingle: int, most: int = MOST, most_words: int = MOST_WORDS) -> DataFrame:
    """(src, dst): links between the names of texts whose shingle sets have this Jaccard similarity or more,
    which join all of each such group.

    ``candidates`` has grp, name, text, and the group's count n and words. A large group is cut into slices,
    and each two slices meet in a part of their own.
    """
    slices = F.ceil(F.greatest(F.col("n") / most, F.col("words") / most_words, F.lit(1))).cast("int")
    mine = F.pmod(F.xxhash64("name"), slices).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.struct(F.least(o, mine).alias("p"), F.greatest(o, mine).alias("q")))
    parts = candidates.select("grp", F.explode(pairs).alias("s"), "name", "text").select("grp", "s.p", "s.q", "name", "text")
    dealt = parts.repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "name")

    def run(batches):
        now, names, sets = None, [], []
        for batch in batches:
            for grp, p, q, name, text in zip(*[batch.column(i) for i in range(5)]):
                key = grp.as_py(), p.as_py(), q.as_py()
                if key != now:
                    yield _pairs(_text_forest(names, sets, similarity))
                    now, names, sets = key, [], []
                names.append(name.as_py())
                sets.append(_shingle_hashes(_words(text.as_py() or ""), shingle))
        yield _pairs(_text_forest(names, sets, similarity))
    return dealt.mapInArrow(run, "src binary, dst binary").distinct()


def _text_forest(names: list[bytes], sets: list[np.ndarray], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join each group of texts whose sets are similar; two empty sets are alike."""
    size = np.array([len(x) for x in sets], np.int64)
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            low, high = np.minimum(size[left], size[at]), np.maximum(size[left], size[at])
            fit = low >= similarity * high
            near = fit.copy()
            for i in np.flatnonzero(fit & (high > 0)).tolist():
                x = sets[left[i]]
                both = int((sets[at][np.minimum(np.searchsorted(sets[at], x), size[at] - 1)] == x).sum())
                near[i] = both >= similarity * (len(x) + int(size[at]) - both)
            if near.any():
                new = left[near].tolist()
                out += [(names[at], names[x]) for x in new]
                todo += new
                left = left[~near]
    return out


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-equal texts: the one with the smallest id (no id last),
    then the smallest content key. Of repeated rows one stays. Null and empty texts are one group.

    Texts with equal words are folded. Near fingerprints make groups of candidates; inside a group the exact
    Jaccard similarity of the texts decides, so each text is read again once and not once for each block.
    """
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": row_key()})
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("name", T.BinaryType()), T.StructField("words", T.LongType()), T.StructField("fp", T.BinaryType())])

    def make():
        def work(part, texts):
            words = [_words(t) for t in texts]
            return [part.column(0), part.column(1), [xxhash.xxh3_128_digest(b" ".join(w)) for w in words], [len(w) for w in words], [long_fingerprint(w, shingle) for w in words]]
        return work
    marks = materialise(per_slice(rows.select("__id", "__key", "text"), "text", out, make), "long")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    folded = materialise(marks.groupBy("name").agg(F.min(place).alias("first"), F.first("words").alias("words"), F.first("fp").alias("fp")), "folded")
    grouped = materialise(components(long_links(folded.select("fp").distinct(), similarity)), "candidates")
    tested = folded.join(grouped, folded.fp == grouped.node, "left").select("name", "words", "first", F.coalesce("component", "fp").alias("grp"))
    sizes = tested.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("total")).where("n > 1").withColumnRenamed("grp", "_g")
    tested = tested.join(sizes, F.col("grp") == F.col("_g")).select("grp", "name", "n", F.col("total").alias("words"), F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    tested = materialise(tested, "tested")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(tested, F.col("key")))

    def marked(batches):
        held = wanted.value
        for batch in batches:
            yield batch.filter(pa.array(held.have(batch.column(1).to_numpy())))
    texts = rows.select("__id", "__key", "text").mapInArrow(marked, "__id long, __key long, text string")
    bodies = tested.join(texts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).select("grp", "name", "n", "words", "text")
    near = materialise(components(verified_links(bodies, similarity, shingle)), "near")
    low = near.join(folded, near.node == folded.name).groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("low"))
    named = near.join(low, near.component == low["_c"]).select(F.col("node").alias("name"), "low")
    stays = folded.join(named, "name", "left").select(F.coalesce("low", "first").alias("s")).distinct().select(F.col("s.id").alias("_id"), F.col("s.key").alias("_key"))
    kept = rows.join(stays, F.col("__id").eqNullSafe(F.col("_id")) & (F.col("__key") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["__id", "__key"]).select(*[F.col(f"`{c}`") for c in docs.columns])
