import random

import duckdb
import numpy as np
import pytest

from cohortry.llm import jaccard, queries
from cohortry.llm.common import F, bit_map, row_key


def brute(rows, percent=85):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            both, either = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if both and 100 * both >= percent * either:
                group[root(a)] = root(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return sorted(((i, len(s), low.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Chains of texts at and about the bound, copies, a passage in most texts, families, very short texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(words, k=60))
    out = []
    for _ in range(60):
        n = rng.choice([3, 4, 8, 20, 60, 200])
        base = rng.choices(words, k=n)
        for _ in range(rng.choice([1, 1, 2, 5])):
            base = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base) + (" " + passage if rng.random() < 0.5 else ""))
    family = rng.choices(words, k=150)
    for i in range(150):
        own = list(family)
        own[rng.randrange(150)] = f"own{i}"
        out.append(" ".join(own))
    out += [None, "", "  \n", "One", "one", "ONE  two", "Ä b c d e", "ä b c d e", "Ä B c d e"]
    rows = list(enumerate(out))
    return rows + [(None, out[0]), (3, out[3]), (3, "same id, another text here"), (None, "no id and no partner at all")]


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "n", "name", 7) for i, t in rows], "doc_id long, text string, n string, name string, h long")
    return sorted(map(tuple, jaccard.linked(df.repartition(5), **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_links_equal_all_pairs(spark, corpus):
    assert found(spark, corpus) == brute(corpus)


def test_small_slices_and_another_bound(spark, corpus):
    assert found(spark, corpus, most=16, percent=60) == brute(corpus, 60)


def test_pairs_are_passed_on_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 2)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.linked(df, most=8).collect()), key=str) == brute(corpus)


def test_pairs_of_near_copies_are_passed_on_once_and_not_once_a_tile(spark):
    rng, base, entries, sigs = random.Random(3), [b"b%d" % i for i in range(120)], [], []
    for k in range(24):
        v = list(base)
        v[rng.randrange(4, 116)] = b"n%d" % k
        held = jaccard.shingle_set(v)
        sigs.append((bytes([k]), bytearray(jaccard.signature(held))))
        entries += [(int(h), bytes([k]), len(held)) for h in jaccard.prefix(held, np.zeros(jaccard.CELLS, np.uint8), 85).view(np.int64)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        tiles = jaccard.tiles_of(spark.createDataFrame(entries, "h long, name binary, n int"), 85)
        found = jaccard._candidates(jaccard._cells(tiles, None, False, jaccard.MOST), spark.createDataFrame(sigs, "name binary, sig binary"), None, 85, False)
        pairs = [frozenset((bytes(r.a), bytes(r.b))) for r in found.where("a is not null").collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(set(pairs)) > 24 and len(pairs) <= 4 * len(set(pairs)), (len(pairs), len(set(pairs)))


def test_marked_texts_need_one_process(spark):
    """Rows are picked and hashed by the same process of a task: a second one would hold another copy of the map and the texts."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None)], "doc_id long, text string")
    marks = spark.sparkContext.broadcast(bit_map(docs.where("doc_id = 1").select(row_key().alias("key")), F.col("key")))
    bodies = jaccard._bodies(docs, marks, 4)
    assert bodies._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [len(r["body"]) for r in bodies.collect()] == [16]


def test_odd_tables(spark, docs, no_docs):
    assert jaccard.linked(no_docs).count() == 0
    got = jaccard.linked(docs).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id in (1, 7)} == {1} and {r.n_shingles for r in got if r.doc_id in (2, 3, 6)} == {0}


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    name = "op13_jaccard_size_tiles"
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf).select("doc_id", "n_shingles", "component_id").collect())) == sorted(con.sql(queries.SQL[name]).fetchall())


def test_bitmaps_bound_the_overlap_and_prefixes_meet():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, 4, jaccard.CELLS).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.7, 0.9, 1.0])], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        x, y = jaccard.signature(a), jaccard.signature(b)
        width = min(len(x), len(y))
        s, t = jaccard.folded(x, width), jaccard.folded(y, width)
        assert both <= len(a) - np.bitwise_count(s & ~t).sum() and both <= len(b) - np.bitwise_count(t & ~s).sum()
        near = 100 * both >= 85 * (len(a) + len(b) - both)
        assert jaccard.similar(a, b, 85) == near
        if near:
            assert len(np.intersect1d(jaccard.prefix(a, classes, 85), jaccard.prefix(b, classes, 85)))
