import hashlib
import re
import zlib

import numpy as np

from cohortry.llm import decontaminate, pii, quality, toxicity
from cohortry.llm.common import F


def slow_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k:k + 8]), []).append(k)
    again = {x for v in at.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(again)


def test_quality_counts(docs, sample, no_docs):
    for df in (docs, sample):
        got = quality.statistics(df).collect()
        assert sorted(((r.doc_id or -1, *r[1:6]) for r in got)) == sorted((d or -1, *slow_counts(t)) for d, t in df.select("doc_id", "text").collect())
    assert quality.statistics(no_docs).count() == 0


def test_decision_list_learns_and_prunes():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in quality.FEATURES}
    low = ((x["upper"] > 0.8) & (x["bangs"] > 0.5)) | (x["symbols"] > 0.9)
    rules = quality.learn(x, low, np.arange(3000) % 3)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._cover(r, x, 3000)
    assert (hit == low).mean() > 0.98 and {t.feature for r in rules for t in r} == {"upper", "bangs", "symbols"}
    assert quality.learn(x, np.zeros(3000, bool), np.arange(3000) % 3) == []


def test_decision_list_in_spark_equals_arrays(sample, spark, sf):
    stats = quality.statistics(sample)
    rules = [(quality.Test("upper", True, 0.1), quality.Test("words", False, 400.0)), (quality.Test("symbols", True, 0.2),)]
    for r in quality.judge(stats, rules).collect():
        low = (r.n_upper / max(r.word_chars, 1) > 0.1 and r.n_words <= 400) or r.n_symbols / max(r.n_words, 1) > 0.2
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and not low)


def test_quality_keeps_good_documents(spark):
    root = "/root/testdata/sf0.1"
    stats = quality.statistics(spark.read.parquet(f"{root}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{root}/labels.parquet")
    judged = quality.judge(stats, quality.fit(stats, labels)).join(labels, "doc_id").where("not base_failed")
    r = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    share = {x.quality: x.kept for x in r}
    assert share[1] > 0.99 and share[0] < 0.5


def slow_hits(rows, items):
    p = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    windows = {}
    for i, t in items:
        w = p.findall((t or "").translate(low))
        for k in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = p.findall((t or "").translate(low)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((d or -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, sf, sample, docs, no_docs, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    odd = spark.createDataFrame([(1, "Second LINE here"), (2, None), (3, ""), (4, "no words match this one"), (5, "alpha, beta; gamma"), (5, "alpha, beta; gamma"), (11, "of1 word2")], "item_id long, text string")
    for d, b in ((sample, items), (docs, odd)):
        want = slow_hits(d.select("doc_id", "text").collect(), b.collect())
        for block in (50_000, 3 if b is odd else 500):  # one block, and many
            with monkeypatch.context() as m:
                m.setattr(decontaminate.hits, "__defaults__", (10, block))
                assert sorted((r.doc_id or -1, *r[1:]) for r in decontaminate.report(d, b).collect()) == want
    assert decontaminate.report(no_docs, items).count() == 0
    assert decontaminate.report(docs, odd.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.clean(docs, odd)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 2, 3, 6, 8, 9, 10}


def test_toxicity_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = toxicity.scored(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r.toxic for r in got]), np.array([r.score for r in got])
    assert (y == (s >= 0.5)).mean() > 0.97 and all(r.predicted == (r.score >= 0.5) for r in got)
    pos, neg = s[y == 1], s[y == 0]
    assert (pos[:, None] > neg[None, :]).mean() > 0.9


def test_toxicity_cases(spark, sf, docs, no_docs, sample):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(sample, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r.predicted for r in toxicity.scored(docs, None).collect()} == {0}
    assert toxicity.keep_ordinary(no_docs, model).count() == 0 and toxicity.keep_ordinary(docs, None).count() == docs.count()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, *m.span()))
    return out


def test_pii_base_equals_patterns(sample, docs):
    odd = ["a@b", "a@b.c@d.e", "@x.y z@@q.r a.b@c.d.", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.4", "4111 1111-1111 1111", "4111111111111112", "+1 (736) 555-2678", "+1+23456789012", "0" * 4000 + ".1.1.1", "é1.2.3.4é"]
    for t in [*odd, *[r.text or "" for r in sample.union(docs.select(sample.columns)).collect()]]:
        assert sorted(pii.base_spans(t)) == sorted(slow_base(t)), t[:80]


def test_pii_skip_links_carry_labels(sample):
    field = pii.fit(sample)
    text = "Reach me at +1 (736) 555-2678 today. Much later the same 555-2678 again; order 12 of 2678 items."
    (base, spans), = pii.find([text], field)
    assert set(base) < set(spans) and (3, text.rindex("555-2678"), text.rindex("555-2678") + 8) in spans


def test_pii_cases(docs, no_docs, sample):
    field = pii.fit(sample)
    got = pii.detect(docs, field).collect()
    assert len(got) == docs.count() and sum(r.n_ip for r in got) == 1
    none = [r for r in got if r.doc_id in (2, 3)]
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in none)
    assert pii.detect(no_docs, field).count() == 0 and pii.detect(docs, None).count() == docs.count()
    assert pii.fit(no_docs) is None


def test_messages_agree_with_enumeration():
    """On a tree, message passing gives the exact marginals."""
    rng = np.random.default_rng(0)
    field = pii.Field({}, np.zeros((1, 5)), rng.normal(size=(5, 5)), np.eye(5))
    n = pii.Nodes([(0, 1), (2, 3), (4, 5)], ["1", "2", "3"], [False, True, False], [(1, 2)], [2, 0, 0], [set()] * 3)
    got = pii.beliefs(field, [n])
    p = np.zeros((5, 5))
    for b in range(5):
        for c in range(5):
            p[b, c] = np.exp(field.chain[2, b] + field.skip[b, c])
    p /= p.sum()
    assert np.allclose(got[1], p.sum(axis=1), atol=1e-2) and np.allclose(got[2], p.sum(axis=0), atol=1e-2)
