"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash

from cohortry.llm.common import DataFrame, F, T, bit_map, materialise, per_slice, plain, row_key, sized_slices
from cohortry.operators.graph import components

SHINGLE = 4
PERCENT = 85
CELLS = 1 << 22        # counters of the frequency sketch
STEPS = 1.4            # ratio of counts between two frequency classes
PAGE = 4096
MOST = 4096            # texts of a tile that one task compares with each other
LIMITS = (3, 16, None)  # candidates of a text in a tile: the last round has no limit
BITS = (512, 32768)    # least and most bits of a signature
STEP = 64
HELD = 50_000         # pairs a task holds before it passes them on; repeats among them are removed later
DEALS = 2             # tasks that share the tiles of a group of near copies
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none give none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(shingle, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k:n - width + 1 + k]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return np.unique(out)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and only the six ASCII blanks


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap with a bit for each hash, about four bits a shingle, a power of two wide."""
    bits = min(max(BITS[0], 1 << (4 * len(hashes) - 1).bit_length()), BITS[1])
    held = np.zeros(bits, bool)
    held[hashes & np.uint64(bits - 1)] = True
    return np.packbits(held, bitorder="little").tobytes()


def prefix(hashes: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles, so many that two sets at the wanted similarity share one of them. The order is by
    frequency class, then hash: the same for all sets."""
    n = len(hashes)
    order = np.argsort(classes[hashes & np.uint64(CELLS - 1)], kind="stable")
    return hashes[order[: n - (percent * n + 99) // 100 + 1]] if n else hashes


def _scan(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document (doc_id, key, name, n), and the pages of the task's sketch of shingle counts."""
    def run(batches):
        cells, last = np.zeros(CELLS, np.int32), []
        for batch in batches:
            for part in sized_slices(batch, 2):
                names, sizes = [], []
                for t in part.column(2):  # a text at a time: words as objects take ten times its bytes
                    words = words_of(t.as_py() or "")
                    held = shingle_set(words, shingle)
                    cells[(held & np.uint64(CELLS - 1)).astype(np.int64)] += 1  # a text counts once in a cell
                    names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                    sizes.append(len(held))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "key": part.column(1), "name": pa.array(names, pa.binary()),
                                                  "n": pa.array(sizes, pa.int64()), "page": pa.nulls(len(sizes), pa.int32()), "counts": pa.nulls(len(sizes), pa.binary())})
        for p in range(CELLS // PAGE):
            if (held := cells[p * PAGE:(p + 1) * PAGE]).any():
                last.append((p, np.minimum(held, 255).astype(np.uint8).tobytes()))  # a task counts to 255
        if last:
            empty = len(last)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.nulls(empty, pa.int64()), "key": pa.nulls(empty, pa.int64()), "name": pa.nulls(empty, pa.binary()), "n": pa.nulls(empty, pa.int64()),
                                              "page": pa.array([p for p, _ in last], pa.int32()), "counts": pa.array([c for _, c in last], pa.binary())})
    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    return materialise(rows.mapInArrow(run, "doc_id long, key long, name binary, n long, page int, counts binary"), "scan")


def _classes(scan: DataFrame) -> np.ndarray:
    """Frequency class of each cell of the sketch: how many steps its count is above the mean. Four megabytes, whatever
    the input; a class only orders shingles, so one that is off costs time and no result."""
    def run(batches):
        now, total = None, None
        for batch in batches:
            for page, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = np.frombuffer(counts.as_py(), np.uint8).astype(np.int64)
                if page != now:
                    if now is not None:
                        yield _page(now, total)
                    now, total = page, held
                else:
                    total = total + held
        if now is not None:
            yield _page(now, total)
    pages = scan.where("page is not null").select("page", "counts").repartition("page").sortWithinPartitions("page").mapInArrow(run, "page int, counts binary").collect()
    cells = np.zeros(CELLS, np.float32)
    for r in pages:  # at most CELLS / PAGE rows
        cells[r["page"] * PAGE:(r["page"] + 1) * PAGE] = np.frombuffer(r["counts"], np.float32)
    return np.floor(np.log(np.maximum(1, cells / max(1.0, float(cells.mean())))) / np.log(STEPS)).astype(np.uint8)


def _page(page: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"page": pa.array([page], pa.int32()), "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _per_text(docs: DataFrame, marks, out: T.StructType, make) -> DataFrame:
    """``make()(words)``, one row, of the texts whose key is marked in the broadcast map. One process of a task picks the rows and
    works on them, a text at a time."""
    def start():
        work = make()

        def run(part, texts):
            rows = [work(words_of(texts[i])) for i in np.flatnonzero(marks.value.have(part.column(0).to_numpy())).tolist()]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in out.fields]
        return run
    return per_slice(plain(docs, "doc_id", "text").select(row_key().alias("key"), "text"), "text", out, start)


def _heads(docs: DataFrame, marks, classes, shingle: int, percent: int) -> DataFrame:
    """(name, n, heads, sig): size, prefix shingles and bitmap of each marked text."""
    out = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("heads", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def make():
        def work(words):
            held = shingle_set(words, shingle)
            return xxhash.xxh3_128_digest(b" ".join(words)), len(held), prefix(held, classes.value, percent).view(np.int64), signature(held)
        return work
    return _per_text(docs, marks, out, make)


def _bodies(docs: DataFrame, marks, shingle: int) -> DataFrame:
    """(name, body): the sorted shingle hashes of each marked text."""
    out = T.StructType([T.StructField("name", T.BinaryType()), T.StructField("body", T.BinaryType())])

    def make():
        return lambda words: (xxhash.xxh3_128_digest(b" ".join(words)), shingle_set(words, shingle).tobytes())
    return _per_text(docs, marks, out, make).groupBy("name").agg(F.first("body").alias("body"))


def short_key(h):
    """The low 40 bits of a hash: what is counted for a map of marks needs no more, and fewer bytes are shuffled."""
    return h.bitwiseAND(F.lit((1 << 40) - 1).cast("long"))


def marked(rows: DataFrame, key, wanted: DataFrame, value) -> DataFrame:
    """The rows whose ``key`` is among the ``value`` of ``wanted``; a chance hit of the map stays, so a join decides behind it."""
    marks = rows.sparkSession.sparkContext.broadcast(bit_map(wanted, value))
    keyed = rows.select(key.alias("_mark"), *rows.columns)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(marks.value.have(batch.column(0).to_numpy())))
    return keyed.mapInArrow(run, keyed.schema).drop("_mark")


def banded(entries: DataFrame, percent: int) -> DataFrame:
    """Each entry (h, name, n) in the tile of its own size band, and as a visitor in the next: sizes that may be similar
    lie in one band or in neighbours."""
    width = -math.log((percent - 1) / 100)
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    return entries.select("h", F.explode(F.array(F.struct(own.alias("band"), F.lit(True).alias("own")), F.struct((own + 1).alias("band"), F.lit(False).alias("own")))).alias("b"), "name", "n").select("h", "b.band", "b.own", "name", "n")


def tiles_of(entries: DataFrame, percent: int) -> DataFrame:
    """(h, band, own, name, n) of the tiles with something to compare; of tiles with the same texts one is kept. Most tiles
    hold one text: tiles are counted by a hash first, and only rows of those with more are shuffled whole."""
    rows = banded(entries, percent)
    key = short_key(F.xxhash64("h", "band"))
    some = rows.select(key.alias("k"), "own").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o")).where("c > 1 and o")
    rows = marked(rows, key, some, F.col("k"))
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "name", "own")).alias(f"x{k}") for k in (1, 2)]
    alike = rows.groupBy("h", "band").agg(F.count(F.lit(1)).alias("c"), F.count_if("own").alias("o"), *mark).where("c > 1 and o > 0")
    return rows.join(alike.groupBy("band", "c", "o", "x1", "x2").agg(F.min("h").alias("h")).select("h", "band"), ["h", "band"])


def _cells(tiles: DataFrame, comp: DataFrame | None, first: bool, most: int) -> DataFrame:
    """(h, band, slice, partly, own, name, n, comp, drives, deal): what is to be compared, and who looks for partners. Tiles whose texts are all of one component are
    left out. ``deal`` is the smallest hash of a tile's names: tiles of nearly the same texts mostly agree in it. A tile of more than ``most`` texts is cut into slices by hash; the texts outside its largest component visit
    all slices, those inside stay at home: among them nothing is left to find. The first round has no visits."""
    rows = tiles if comp is None else tiles.join(comp.select(F.col("node").alias("name"), "component"), "name", "left")
    rows = rows.withColumn("comp", F.coalesce("component", "name") if comp is not None else F.col("name"))
    sizes = rows.groupBy("h", "band", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("o"), F.min(F.xxhash64("name")).alias("d"))
    cut = (sizes.groupBy("h", "band").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("parts"), F.max("o").alias("any_own"), F.max_by("comp", F.struct("c", "comp")).alias("large"), F.min("d").alias("deal"))
           .where("parts > 1 and any_own").select("h", "band", F.ceil(F.col("total") / most).cast("int").alias("slices"), "large", "deal"))
    home = F.pmod(F.xxhash64("name"), F.col("slices")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("slices") - 1)
    where = F.array(home) if first else F.when(F.col("comp") == F.col("large"), F.array(home)).otherwise(everywhere)
    return rows.join(cut, ["h", "band"]).select("h", "band", F.explode(where).alias("slice"), (F.lit(first) & (F.col("slices") > 1)).alias("partly"), "own", "name", "n", "comp", (F.lit(True) if first else F.col("comp") != F.col("large")).alias("drives"), "deal")


def _candidates(cells: DataFrame, sigs: DataFrame, limit: int | None, percent: int, first: bool) -> DataFrame:
    """(a, b, score): pairs of different components whose bitmaps allow the wanted overlap: for each text a that looks for partners
    at most ``limit`` in a slice of a tile, those nearest in size first, smaller ones before larger ones. Texts of a tile's largest
    component need not look: whoever is outside looks for them. Rows without a pair name the tiles (h, band) that have to be looked
    at again: where the limit was met or slices had no visits, and in the first round, which tests one partner of a text, where any was found.
    Tiles of nearly the same texts go to one of DEALS tasks, where a pair they share is passed on once and not once a tile."""
    rows = cells.join(sigs, "name").select("h", "band", "slice", "own", "n", "name", "comp", "sig", "drives", "partly", "deal")
    rows = rows.withColumn("turn", F.pmod(F.xxhash64("h"), F.lit(DEALS)))
    dealt = rows.repartition("deal", "turn", "band", "slice").sortWithinPartitions("deal", "turn", "h", "band", "slice", "n", "name").drop("deal", "turn")

    def cell(part: pa.Table, out: dict):
        m, tile = part.num_rows, (part.column("h")[0].as_py(), part.column("band")[0].as_py())
        if part.column("partly")[0].as_py():
            out[tile] = None
        own, drives, n = part.column("own").to_numpy(), part.column("drives").to_numpy(), part.column("n").to_numpy().astype(np.int64)
        if m < 2 or not own.any() or not drives.any():
            return
        names, sigs = part.column("name").to_pylist(), part.column("sig").to_pylist()
        comp = np.unique(np.array(part.column("comp").to_pylist(), object), return_inverse=True)[1]
        width = min(map(len, sigs))
        bits = np.stack([folded(s, width) for s in sigs])

        def partners(i: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = at[comp[at] != comp[i]]
            more_i, more_j = np.bitwise_count(bits[i] & ~bits[at]).sum(axis=1, dtype=np.int64), np.bitwise_count(bits[at] & ~bits[i]).sum(axis=1, dtype=np.int64)
            bound = np.minimum(n[i] - more_i, n[at] - more_j)
            share = bound / (n[i] + n[at])
            good = bound * (100 + percent) >= percent * (n[i] + n[at])
            return at[good], share[good]
        for i in np.flatnonzero(drives).tolist():
            found = 0
            low, high = int(np.searchsorted(n, -(-percent * int(n[i]) // 100))), int(np.searchsorted(n, 100 * int(n[i]) // percent, side="right"))
            below = [np.arange(max(low, e - STEP), e)[::-1] for e in range(i, low, -STEP)] if own[i] else []
            above = [np.arange(b, min(high, b + STEP)) for b in range(i + 1, high, STEP)]
            for at in [*below, *above]:
                near, share = partners(i, at if at[0] < i else at[own[at]])
                if limit is not None:
                    near, share = near[: limit - found], share[: limit - found]
                for j, v in zip(near.tolist(), share.tolist()):
                    pair = (names[i], names[j]) if first or names[i] < names[j] else (names[j], names[i])
                    out[pair] = min(v, out.get(pair, v))
                found += len(near)
                if found == limit or first and found:
                    out[tile] = None
                if found == limit:
                    break
                if len(out) > HELD:
                    yield _pairs(out)
                    out.clear()
        if len(out) > HELD:
            yield _pairs(out)
            out.clear()

    def run(batches):
        held, now, out = [], None, {}
        for batch in batches:
            at = np.column_stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for s, e in zip(cuts, cuts[1:]):
                if e > s:
                    if now is not None and now != tuple(at[s]):
                        yield from cell(pa.Table.from_batches(held), out)
                        held = []
                    now = tuple(at[s])
                    held.append(batch.slice(s, e - s))
        if held:
            yield from cell(pa.Table.from_batches(held), out)
        if out:
            yield _pairs(out)
    return dealt.mapInArrow(run, "a binary, b binary, score double, h long, band int")


def folded(sig: bytes, width: int) -> np.ndarray:
    """A bitmap at a smaller width: halves laid over each other."""
    bits = np.frombuffer(sig, np.uint64)
    while len(bits) * 8 > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2:]
    return bits


def _pairs(out: dict) -> pa.RecordBatch:
    rows = [(*k, v, None, None) if v is not None else (None, None, None, *k) for k, v in out.items()]
    kinds = (("a", pa.binary()), ("b", pa.binary()), ("score", pa.float64()), ("h", pa.int64()), ("band", pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: sorted distinct hashes are intersected."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """(src, dst) of the pairs that are similar."""
    one, two = bodies.select(F.col("name").alias("a"), F.col("body").alias("body_a")), bodies.select(F.col("name").alias("b"), F.col("body").alias("body_b"))
    whole = pairs.join(one, "a").join(two, "b").select("a", "b", "body_a", "body_b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(part.column(2), part.column(3))]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in (part.column(0), part.column(1))], names=["src", "dst"])
    return whole.mapInArrow(run, "src binary, dst binary")


def linked(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """(doc_id, n_shingles, component_id): sets of ``shingle``-word shingles link at a Jaccard similarity of
    ``percent`` hundredths or more; the component is the smallest doc_id reachable.

    Texts of equal words are folded first. Each set sends its rarest shingles; a tile holds the sets of a size band that share
    one of them, and of tiles with the same texts one is kept. In a tile bitmap signatures bound the overlap from above;
    what they let through is intersected exactly. Rounds test few candidates of each text first, then only pairs of
    different components, in the last round all that are left: no link between two components is lost, and a group of
    near copies does not give all its pairs. A null, empty or blank text has no shingles and links with nothing. A repeated row
    gives a repeated result; null ids never name a component; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scan = _scan(docs, shingle)
    classes = spark.sparkContext.broadcast(_classes(scan))
    rows = scan.where("page is null").select("doc_id", "key", "name", "n")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    texts = materialise(rows.where("n > 0").groupBy("name").agg(F.min(place).alias("p")).select("name", F.col("p.doc_id").alias("first"), F.col("p.key").alias("key")), "texts")
    heads = materialise(_heads(docs, spark.sparkContext.broadcast(bit_map(texts, F.col("key"))), classes, shingle, percent), "heads")
    shared = spark.sparkContext.broadcast(bit_map(heads.select(F.explode("heads").alias("h")).select(short_key(F.col("h")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), F.col("h")))

    def common(batches):
        for batch in batches:
            h = batch.column(2).flatten().to_numpy()
            hit = shared.value.have(h)
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(h[hit])], names=["name", "n", "h"])
    met = heads.select("name", "n", "heads").mapInArrow(common, "name binary, n int, h long").groupBy("h", "name").agg(F.first("n").alias("n"))
    tiles = materialise(tiles_of(materialise(met, "met"), percent), "tiles")
    sigs = materialise(heads.select("name", "sig").join(tiles.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.first("sig").alias("sig")), "signatures")
    links = tested = near = bodies = None
    for i, limit in enumerate(LIMITS):
        cells = _cells(tiles, near, i == 0, most)
        if i:  # few texts are left: only their bitmaps are dealt, and below only their bodies
            cells = materialise(cells, "cells")
        found = materialise(_candidates(cells, marked(sigs, F.xxhash64("name"), cells, F.xxhash64("name")) if i else sigs, limit, percent, i == 0), "candidates")
        tiles = tiles.join(found.where("a is null").select("h", "band").distinct(), ["h", "band"], "left_semi")
        pairs = found.where("a is not null")
        if i == 0:  # the most promising partner of each text alone
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
        if bodies is not None:
            asked = asked.join(bodies.select("name"), "name", "left_anti")
        asked = materialise(asked.join(texts, "name").select("name", "key"), "asked")
        if not asked.isEmpty():
            more = _bodies(docs, spark.sparkContext.broadcast(bit_map(asked, F.col("key"))), shingle)
            more = materialise(more.join(asked.select("name"), "name", "left_semi"), "bodies")
            bodies = more if bodies is None else bodies.unionByName(more)
        both = pairs.select(F.explode(F.array("a", "b")).alias("name"))
        new = materialise(_verified(pairs, marked(bodies, F.xxhash64("name"), both, F.xxhash64("name")) if i else bodies, percent), "links")
        links = new if links is None else links.unionByName(new)
        near = materialise(components(links), "near")
    if near is None:
        home = texts.select("name", F.col("first").alias("component_id"))
    else:
        low = near.join(texts, near.node == texts.name).groupBy("component").agg(F.min("first").alias("low"))
        named = near.join(low, "component").select(F.col("node").alias("name"), "low")
        home = texts.join(named, "name", "left").select("name", F.coalesce("low", "first").alias("component_id"))
    some = rows.where("n > 0").join(home, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
