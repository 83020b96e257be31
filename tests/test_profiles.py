"""Hand-made edge cases: ties, repeats, empty sets, the cut at theta, truncation of the future."""

from pyspark.sql import functions as F

from cohortry.functions.columns import jaccard
from cohortry.operators import cohort as C, profiles as P
from cohortry.specs import CohortSpec, FeatureSpec

import pytest


def tagged(spark, rows):
    return spark.createDataFrame(rows, "subject long, event_id long, period int, tag string, tag_pos int")


def test_collapse_keeps_best_place_and_first_three(spark):
    occ = spark.createDataFrame([(1, "x", 0.9, 1), (1, "x", 0.95, 2), (1, "y", 0.9, 3), (1, "z", 0.29, 4), (1, "w", 0.5, 5), (1, "v", 0.4, 6)], "e long, tag string, score double, line int")
    got = {r["tag"]: r["tag_pos"] for r in P.collapse_tags(occ, ["e"], "tag", "score", ["line"], 0.3, 3).collect()}
    assert got == {"x": 1, "y": 2, "w": 3}


def test_tie_at_rank_k_goes_to_first_appearance(spark):
    t = tagged(spark, [(1, 5, 1, "b", 1), (1, 6, 2, "a", 1), (1, 7, 3, "c", 1), (1, 8, 4, "c", 1)])
    counts = P.tag_counts(t, ["subject"])
    first = P.profile(counts, ["subject"], 2).first()
    assert first["tags"] == ["b", "c"] and first["tags_breadth"] == 3
    assert P.profile(counts, ["subject"], 2, ties="name").first()["tags"] == ["a", "c"]


def test_asof_intervals_equal_direct_truncation(spark):
    rows = [(1, i, i % 7, "abcde"[(i * i) % 5], 1 + i % 3) for i in range(60)]
    t = tagged(spark, rows)
    cuts = spark.createDataFrame([(1, c) for c in range(0, 7)], "subject long, cut int")
    act = t.groupBy("subject", "period").agg(F.count_distinct("event_id").alias("n_events"))
    got = {r["cut"]: r for r in P.asof_profiles(P.history_steps(t, "subject"), act, cuts, "subject", 3).collect()}
    for c in range(0, 7):
        d = P.profile(P.tag_counts(t.where(F.col("period") <= c), ["subject"]), ["subject"], 3).first()
        assert got[c]["tags"] == d["tags"] and got[c]["breadth"] == d["tags_breadth"]
        assert got[c]["prod"] == sum(1 for r in rows if r[2] <= c)


def test_overlap_of_empty_sets_and_threshold_equality(spark):
    df = spark.createDataFrame([([], ["a"]), (None, ["a"]), (list("abcdef"), list("efghij"))], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.2]
    assert [r[0] for r in df.select(C.label(F.col("a"), F.col("b"), 0.2)).collect()] == [0, 0, 0]


def test_first_failing_reason_and_subject_dedupe(spark):
    cols = "subject long, source long, t0 int, last_period int, early_prod int, late_prod int, source_prod int, source_first int, source_last int"
    rows = [(1, 1, None, None, 0, 0, 9, 7990, 7999), (2, 1, 7985, 7999, 5, 5, 9, None, None), (3, 1, 8000, 8001, 9, 9, 9, 7990, 7999), (4, 1, 7000, 7001, 5, 5, 5, 7000, 7001),
            (5, 1, 7985, 8060, 5, 5, 5, 7985, 7999), (6, 1, 7985, 7999, 2, 5, 5, 7985, 7999), (7, 9, 7985, 7999, 5, 5, 5, 7985, 7999), (7, 3, 7985, 7999, 5, 5, 5, 7985, 7999)]
    df = spark.createDataFrame(rows, cols).withColumn("r", C.drop_reason(CohortSpec()))
    assert [r["r"] for r in df.orderBy("subject", "source").collect()] == ["no_years", "adv_no_years", "too_recent", "implausible_t0", "span_gt_max", "sparse_windows", None, None]
    assert C.one_row_per_subject(df.where("r is null"), ["source"]).collect() == [(7, 3)]


def test_banned_feature_fails_at_plan_time():
    with pytest.raises(ValueError):
        FeatureSpec(numeric=("early_prod", "late_overlap")).columns()
    assert "t0" not in FeatureSpec().columns(("t0",))


def test_future_events_never_reach_a_feature(spark, sf):
    """Truncate all histories at t0+5: every feature stays; row order and partition count do not matter."""
    from cohortry.plans import catalogue, stages as S
    bad = catalogue.QUERIES["time_contract_exact"](spark, sf).collect()
    assert bad and all(r["violations"] == 0 and r["n_rows"] > 0 for r in bad)
    t = S.subject_tags(spark, sf)
    a = P.profile(P.tag_counts(t, ["subject"]), ["subject"], 10)
    b = P.profile(P.tag_counts(t.orderBy(F.rand(1)).repartition(13), ["subject"]), ["subject"], 10)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_asof_cuts_meet_only_tags_that_can_be_in_the_top(spark):
    """300 tags seen once after ten have come twice: no cut reads them again, and profiles equal direct truncation."""
    rows = [(1, i, 1 + i // 10, f"often{i % 10}", 1) for i in range(20)] + [(1, 100 + i, 3 + i % 5, f"once{i}", 1) for i in range(300)]
    rows += [(2, 900, None, "a", 1), (2, 901, 2, "a", 1), (2, 902, 4, "b", 1), (2, 903, 4, "b", 2), (2, 904, 4, "b", 3), (None, 905, 2, "a", 1)]
    t = tagged(spark, rows)
    cuts = spark.createDataFrame([(s, c) for s in (1, 2) for c in range(1, 9)], "subject long, cut int")
    act = t.groupBy("subject", "period").agg(F.count_distinct("event_id").alias("n_events"))
    steps = P.history_steps(t, "subject")
    for k in (2, 10):
        out = P.asof_profiles(steps, act, cuts, "subject", k)
        got = {(r["subject"], r["cut"]): r for r in out.collect()}
        for s, c in [(1, 1), (1, 2), (1, 5), (1, 8), (2, 2), (2, 3), (2, 4)]:
            seen = [r for r in rows if r[0] == s and (r[2] is None or r[2] <= c)]
            live = {r[3] for r in seen if r[2] is not None}
            d = P.profile(P.tag_counts(spark.createDataFrame([r for r in seen if r[3] in live], "subject long, event_id long, period int, tag string, tag_pos int"), ["subject"]), ["subject"], k).first()
            assert got[s, c]["tags"] == d["tags"] and got[s, c]["breadth"] == len(live)
            assert got[s, c]["prod"] == len([r for r in seen if r[2] is not None])
        assert (2, 1) not in got
    at = cuts.where("subject = 1 and cut > 2").withColumn("_least", F.lit(2))
    assert P.asof_counts(steps, at, "subject").count() == 6 * 10
