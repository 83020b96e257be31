import hashlib
import random

import duckdb
import pytest

from cohortry.llm import linedup, paragraphs


def slow_dedup(rows, least):
    """Texts without later copies, by looking at every run of lines of every document."""
    docs = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    split = {k: k[1].split("\n") for k in docs}
    first, gone = {}, {k: set() for k in docs}
    for k in docs:
        ls = split[k]
        for s in range(len(ls)):
            for e in range(s, min(len(ls), s + 12)):
                first.setdefault(tuple(ls[s:e + 1]), (k, s))
    for k in docs:
        ls = split[k]
        for s in range(len(ls)):
            words = 0
            for e in range(s, min(len(ls), s + 12)):
                words += max(n, len(ls[e]) // 24) if (n := len(ls[e].encode().split())) else 0
                if words >= least and first[tuple(ls[s:e + 1])] != (k, s):
                    gone[k] |= set(range(s, e + 1))
    return {k: "\n".join(x for i, x in enumerate(split[k]) if i not in gone[k]) for k in docs}


@pytest.mark.parametrize("least", [1, 5, 9])
def test_line_dedup_equals_all_runs(spark, least):
    rng = random.Random(least)
    lines = ["a", "b c", "", "one two three four five six", "d e f", "g h"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    got = linedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least).select("doc_id", "text").collect()
    want = slow_dedup(rows, least)
    assert {r.doc_id: r.text for r in got} == {d: want[(d, t)] for d, t in rows}


def test_line_report_equals_sql(sample, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(con.sql(linedup.REPORT_SQL).fetchall())
    assert sorted(tuple(r) for r in linedup.report(sample).collect()) == want


def test_line_dedup_cases(docs, no_docs):
    got = [(r.doc_id, r.text) for r in linedup.dedup(docs).collect()]
    assert len(got) == docs.count()
    by = dict(sorted(((d or -1, t) for d, t in got), key=lambda x: str(x)))
    assert by[1].startswith("Alpha") and by[7] == "" and by[2] is None and by[3] == "" and by[6] == "   \n\n  "
    assert sum(1 for d, t in got if d == 5 and t and len(t) > 100_000) == 2  # a repeated row is one document
    assert linedup.dedup(docs).columns[:len(docs.columns)] == docs.columns
    assert linedup.report(no_docs).count() == 0


def test_line_plan_is_native(sample):
    for df in (linedup.report(sample), linedup.later_copies(sample)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def slow_clusters(rows, similarity, least):
    occ = [(d, i, frozenset(paragraphs.shingles(w))) for d, t in rows for i, w in paragraphs.split(t or "", least)]
    group = list(range(len(occ)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a in range(len(occ)):
        for b in range(a):
            x, y = occ[a][2], occ[b][2]
            if len(x & y) >= similarity * len(x | y):
                group[root(a)] = root(b)
    out = {}
    for n, (d, i, _) in enumerate(occ):
        out.setdefault(root(n), set()).add((d, i))
    return {frozenset(v) for v in out.values() if len(v) > 1}


def test_paragraph_clusters_equal_all_pairs(sample):
    got = {}
    for r in paragraphs.clusters(sample).collect():
        got.setdefault(r.cluster_id, set()).add((r.doc_id, r.paragraph))
    assert {frozenset(v) for v in got.values()} == slow_clusters(sample.select("doc_id", "text").collect(), 0.8, paragraphs.LEAST_WORDS)


def test_near_paragraphs_and_slices(spark, monkeypatch):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        w = [f"{g}x{rng.randrange(999)}" for _ in range(80)]
        for k in range(7):
            v = list(w)
            v[rng.randrange(80)] = f"n{k}"
            rows.append((10 * g + k, "short line\n" + " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_clusters(rows, 0.8, 30)
    for most in (2, 2000):
        monkeypatch.setattr(paragraphs.verified_links, "__defaults__", (most,))
        got = {}
        for r in paragraphs.clusters(df).collect():
            got.setdefault(r.cluster_id, set()).add((r.doc_id, r.paragraph))
        assert {frozenset(v) for v in got.values()} == want
    left = {r.doc_id: r.text for r in paragraphs.remove(df).collect()}
    gone = {d for c in want for d, _ in sorted(c)[1:]}
    assert gone and all(("\n" not in t) == (d in gone) for d, t in left.items())


def test_paragraphs_are_compared_once(spark, monkeypatch):
    """The links are written before the components read them: their plan has no comparison left."""
    plans, inner = [], paragraphs.components
    monkeypatch.setattr(paragraphs, "components", lambda e: plans.append(e._jdf.queryExecution().optimizedPlan().toString()) or inner(e))
    text = " ".join(f"w{i}" for i in range(40))
    got = paragraphs.clusters(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.cluster_size, r.kept) for r in got) == [(1, 2, True), (2, 2, False)]
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_paragraph_cases(docs, no_docs):
    assert {r.doc_id for r in paragraphs.clusters(docs, least=5).collect()} == {1, 5, 7}
    assert paragraphs.clusters(no_docs).count() == 0
    assert paragraphs.remove(docs).count() == docs.count()


def test_bands_reach_the_recall():
    b = paragraphs.tune_bands(0.8, 0.999)
    assert 1 - (1 - 0.8 ** paragraphs.ROWS) ** b >= 0.999 > 1 - (1 - 0.8 ** paragraphs.ROWS) ** (b - 1)


def test_text_digest_of_untouched(docs):
    got = {r.doc_id: r.text_sha256 for r in linedup.report(docs).collect()}
    assert got[3] == hashlib.sha256(b"").hexdigest() and got[2] is None


def test_passages_are_found_across_and_inside_lines(spark):
    """A run of 51 words that two texts share is found wherever it begins and however its lines are broken."""
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, sharing = [], set()
    for g in range(60):
        run = words(51)
        for k in range(2):
            body = words(rng.randrange(5, 90)) + run + words(rng.randrange(5, 90))
            width = rng.randrange(7, 29) if (g + k) % 2 else 1000
            rows.append((2 * g + k, "\n".join(" ".join(body[i:i + width]) for i in range(0, len(body), width)).replace("w1", "W1" if k else "w1")))
            sharing.add(2 * g + k)
    rows += [(1000 + i, " ".join(words(200))) for i in range(80)] + [(2000, None), (2001, ""), (2002, "of " * 60), (2003, "A b " + "of " * 60), (2004, " ".join(["x", *words(60)] * 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraphs.passages(df).collect()
    found = {r["doc_id"] for r in got}
    assert len(found & sharing) >= 0.97 * len(sharing) and found - sharing == {2002, 2003}
    texts = {d: t for d, t in rows}
    named = {}
    for r in got:
        body = texts[r["doc_id"]].lower().split()
        named.setdefault(r["cluster_id"], []).append((r["doc_id"], r["word"], body[r["word"]:r["word"] + paragraphs.SPAN], r["kept"], r["cluster_size"]))
        line = texts[r["doc_id"]].split("\n")[r["paragraph"]].lower().split()
        assert line and line[0] in body and body[r["word"]] in line
    for some in named.values():
        assert len({d for d, *_ in some}) == len(some) == some[0][4] >= 2 and len({tuple(w) for _, _, w, _, _ in some}) == 1
        assert [d for d, _, _, kept, _ in some if kept] == [min(d for d, *_ in some)]
    assert not paragraphs.clusters(df).where("doc_id < 1000").collect()
