import random

import numpy as np
import pytest

from cohortry.llm import simhash


def slow_groups(rows, distance):
    """Smallest id reachable, by comparing all pairs."""
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin((rows[i][1] ^ rows[j][1]) & (2**64 - 1)).count("1") <= distance:
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    return [min((x for x in low[root(i)] if x is not None), default=None) for i in range(len(rows))]


def slow_fingerprint(text):
    import re
    import xxhash
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("table", ["docs", "sample"])
def test_groups_equal_all_pairs(table, request):
    docs = request.getfixturevalue(table)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.fp) for r in got) == sorted((d or -1, np.uint64(slow_fingerprint(t)).astype(np.int64)) for d, t in docs.select("doc_id", "text").collect())
    rows = [(r.doc_id, r.fp) for r in got]
    assert [r.component_id for r in got] == slow_groups(rows, 3)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_first(no_docs).count() == 0


def test_large_bucket_is_cut_again(spark):
    """Many fingerprints that share most blocks: groups are the same when every bucket is split."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) & (2**64 - 1) for b in base for k in range(6) for _ in range(12)}
    rows = [(i, simhash._signed(f & (2**64 - 1))) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "id long, fp long")
    want = slow_groups([(i, f) for i, f in rows], 3)
    for most in (2, 4096):
        group = {f: f for _, f in rows}

        def root(x):
            while group[x] != x:
                x = group[x]
            return x
        for e in simhash.links(df, most=most).collect():
            assert bin((e.src ^ e.dst) & (2**64 - 1)).count("1") <= 3
            group[root(e.src)] = root(e.dst)
        low = {}
        for i, f in rows:
            low[root(f)] = min(low.get(root(f), i), i)
        assert [low[root(f)] for _, f in rows] == want


def test_keep_first_finds_similar_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(9999)}" for _ in range(12_000)]
    rows, near = [], []
    for d in range(40):
        w = words[d * 300:d * 300 + 300]
        rows.append((d, " ".join(w)))
        for k in range(3):
            v = list(w)
            for at in rng.sample(range(300), 4):
                v[at] = f"new{rng.randrange(99)}"
            a = {tuple(w[i:i + 5]) for i in range(296)}
            b = {tuple(v[i:i + 5]) for i in range(296)}
            assert len(a & b) / len(a | b) >= 0.8
            rows.append((100 + 10 * d + k, " ".join(v)))
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(40)) <= got and len(got) <= 42


def test_keep_first_is_whole_and_keeps_columns(docs):
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    ids = sorted((r.doc_id or -1) for r in got.collect())
    assert ids == [-1, 1, 2, 5, 8, 8, 9, 10]  # 2, 3, 6 and the null text are one group; 7 repeats 1; 5 was there twice


def test_slices_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, 32, dtype=np.uint8)
    rows = []
    for i in range(60):
        f = base.copy()
        f[i % 32] ^= 1
        rows.append((bytes(f),))
    df = spark.createDataFrame(rows, "fp binary").distinct()
    edges = simhash.long_links(df, 0.8, most=7).collect()
    group = {r.fp: r.fp for r in df.collect()}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for e in edges:
        group[root(bytes(e.src))] = root(bytes(e.dst))
    assert len({root(x) for x in group}) == 1


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i:i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_first_decides_by_exact_similarity(spark):
    """300 pairs just above the bound and 300 pairs well below it."""
    rng = random.Random(8)
    rows, above, below = [], set(), set()
    for d in range(600):
        w = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        v = list(w)
        for at in range(12, 204, 25 if d < 300 else 12)[:4 if d < 300 else 6]:
            v[at] = "other"
        a, b = " ".join(w), " ".join(v)
        (above if jaccard(a, b) >= 0.8 else below).add(d + 1000)
        rows += [(d, a), (d + 1000, b)]
    assert len(above) == len(below) == 300
    got = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(600)) <= got and below <= got
    assert len(above & got) <= 9


def test_candidates_reach_the_recall():
    for n in (10_000, 1_000_000, 100_000_000):
        spots, distance = simhash._choices(n, 0.8)
        assert simhash.candidate_recall(0.8, spots.shape[1], len(spots), distance) >= simhash.RECALL


def test_text_slices_lose_no_link(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        v = list(base)
        v[rng.randrange(100)] = f"n{i}"
        rows.append((b"g", i.to_bytes(1, "big"), " ".join(v), 30, 3000))
    df = spark.createDataFrame(rows, "grp binary, name binary, text string, n long, words long")
    for kw in ({}, {"most": 7}, {"most_words": 400}):
        group = list(range(30))

        def root(x):
            while group[x] != x:
                x = group[x]
            return x
        for e in simhash.verified_links(df, 0.8, 5, **kw).collect():
            group[root(e.src[0])] = root(e.dst[0])
        assert len({root(x) for x in group}) == 1
