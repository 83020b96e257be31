"""Audits and data-quality jobs."""

from pyspark.sql import functions as F

from cohortry.functions.columns import jaccard, keyed_md5, r6, uniform
from cohortry.operators import audit as A, draws as D, profiles, stats
from cohortry.operators.ordering import attach, top_k
from cohortry.plans import aggregates as AG, draws as PD, evaluation as EV, stages as S
from cohortry.plans.aggregates import n_rows
from cohortry.plans.draws import UNI
from cohortry.plans.ingest import scratch
from cohortry.plans.joins import jac
from cohortry.plans.registry import cte, query


@query("time_contract_exact", """
SELECT feature, n_rows, 0::BIGINT AS violations FROM (SELECT count(*) AS n_rows FROM t_cohort) n, (VALUES ('t0'), ('early_prod'), ('early_breadth'), ('early_tags'), ('source_prod'), ('source_breadth'), ('source_tags'), ('source_age')) f(feature)""")
def time_contract_exact(spark, sf):
    """Every feature rebuilt from histories cut at t0+5 equals the one built from full histories.

    The rebuild is an independent formulation: events after the cut are removed first, then profiles
    are counted directly instead of through validity intervals.
    """
    c = S.cohort(spark, sf)
    freeze = c.select("subject", "source", (F.col("t0") + 5).alias("cut"))
    ev = S.subject_activity(spark, sf).join(freeze.select("subject", "cut"), "subject").where("period <= cut")
    b = ev.groupBy("subject").agg(F.min("period").alias("t0"), F.sum("n_events").cast("int").alias("early_prod"))
    tags = S.subject_tags(spark, sf).join(freeze.select("subject", "cut"), "subject").where("period <= cut")
    sp = profiles.profile(profiles.tag_counts(tags, ["subject"]), ["subject"], 10, "early_tags").withColumnRenamed("early_tags_breadth", "early_breadth")
    cuts = freeze.select("source", "cut").distinct()
    act = S.source_activity(spark, sf).join(cuts, "source").where("period <= cut").groupBy("source", "cut").agg(F.sum("n_events").cast("int").alias("source_prod"), F.min("period").alias("source_first"))
    at = S.source_tags(spark, sf).join(cuts, "source").where("period <= cut")
    ap = profiles.profile(profiles.tag_counts(at, ["source", "cut"]), ["source", "cut"], 10, "source_tags").withColumnRenamed("source_tags_breadth", "source_breadth")
    none = F.array().cast("array<string>")
    again = (freeze.join(b, "subject", "left").join(sp, "subject", "left").join(act, ["source", "cut"], "left").join(ap, ["source", "cut"], "left")
             .withColumn("source_age", F.col("t0") - F.col("source_first")).withColumn("early_tags", F.coalesce("early_tags", none)).withColumn("source_tags", F.coalesce("source_tags", none))
             .withColumn("early_breadth", F.coalesce("early_breadth", F.lit(0))).withColumn("source_breadth", F.coalesce("source_breadth", F.lit(0))))
    return A.compare_versions(c, again, ["subject"], ["t0", "early_prod", "early_breadth", "early_tags", "source_prod", "source_breadth", "source_tags", "source_age"])


DRIFT = """
SELECT v.min_score, v.k, count(*) AS n, avg((abs(c.late_overlap - round(v.late_overlap, 4)) < 1e-6)::INT::DOUBLE) AS match, avg(abs(c.late_overlap - round(v.late_overlap, 4))) AS mean_abs, max(abs(c.late_overlap - round(v.late_overlap, 4))) AS max_abs,
 quantile_cont(abs(c.late_overlap - round(v.late_overlap, 4)), 0.5) AS median_abs, quantile_cont(abs(c.late_overlap - round(v.late_overlap, 4)), 0.9) AS p90_abs, avg((c.late_overlap > 0.2::DOUBLE)::INT::DOUBLE) AS base_a, avg((round(v.late_overlap, 4) > 0.2::DOUBLE)::INT::DOUBLE) AS base_b,
 avg(((c.late_overlap > 0.2::DOUBLE) = (round(v.late_overlap, 4) > 0.2::DOUBLE))::INT::DOUBLE) AS po FROM t_variants v JOIN t_cohort c USING (subject) GROUP BY ALL"""
KAP = "CASE WHEN base_a*base_b + (1-base_a)*(1-base_b) >= 1 THEN 1 ELSE (po - (base_a*base_b + (1-base_a)*(1-base_b))) / (1 - (base_a*base_b + (1-base_a)*(1-base_b))) END"
cte("t_drift", DRIFT)


def drift_rows(spark, sf):
    v = EV.variants(spark, sf).select("subject", "min_score", "k", F.round("late_overlap", 4).alias("rebuilt"), F.round("early_overlap", 4).alias("rebuilt_early"))
    return v.join(S.cohort(spark, sf).select("subject", F.col("late_overlap").alias("frozen"), F.col("early_overlap").alias("frozen_early")), "subject")


@query("time_contract_agreement", f"SELECT min_score, k, round(match, 6) AS match_share, round(max_abs, 6) AS max_abs, round({KAP}, 6) AS kappa, match >= 0.99::DOUBLE AS in_band FROM t_drift")
def time_contract_agreement(spark, sf):
    """Rebuilt label family against the frozen one; the frozen setting must agree, the others show drift."""
    d = A.drift(drift_rows(spark, sf), ["min_score", "k"], "frozen", "rebuilt", 0.2)
    return d.select("min_score", "k", r6(F.col("match")).alias("match_share"), r6(F.col("max_abs")).alias("max_abs"), r6(F.col("kappa")).alias("kappa"), (F.col("match") >= 0.99).alias("in_band"))


@query("drift_calibration", f"SELECT min_score, k, n, round(mean_abs, 6) AS mean_abs, round(median_abs, 6) AS median_abs, round(p90_abs, 6) AS p90_abs, round(max_abs, 6) AS max_abs, round(base_a, 6) AS base_a, round(base_b, 6) AS base_b, round({KAP}, 6) AS kappa FROM t_drift")
def drift_calibration(spark, sf):
    d = A.drift(drift_rows(spark, sf), ["min_score", "k"], "frozen", "rebuilt", 0.2)
    return d.select("min_score", "k", "n", *[r6(F.col(c)).alias(c) for c in ("mean_abs", "median_abs", "p90_abs", "max_abs", "base_a", "base_b", "kappa")])


@query("overlap_recompute_assert", "SELECT count(*) AS n, 0::BIGINT AS mismatches, round(max(late_overlap), 6) AS max_overlap FROM t_cohort")
def overlap_recompute_assert(spark, sf):
    """Late overlap by exploding and joining tags instead of array functions."""
    c = S.cohort(spark, sf)
    late, src = c.select("subject", F.explode("late_tags").alias("tag")), c.select("subject", F.explode("source_tags").alias("tag"))
    inter = late.join(src, ["subject", "tag"]).groupBy("subject").agg(n_rows("i"))
    j = c.select("subject", "late_overlap", F.size("late_tags").alias("a"), F.size("source_tags").alias("b")).join(inter, "subject", "left").withColumn("i", F.coalesce("i", F.lit(0)))
    again = F.when((F.col("a") > 0) & (F.col("b") > 0), F.round(F.col("i") / (F.col("a") + F.col("b") - F.col("i")), 4)).otherwise(F.lit(0.0))
    return j.agg(n_rows(), F.count_if(F.abs(again - F.col("late_overlap")) >= 1e-9).alias("mismatches"), r6(F.max(again)).alias("max_overlap"))


@query("late_only_leak", """
WITH e AS (SELECT subject, t0, unnest(early_tags) AS tag FROM t_cohort), l AS (SELECT subject, t0, unnest(late_tags) AS tag FROM t_cohort),
s AS (SELECT DISTINCT c.subject, tag FROM t_cohort c JOIN t_stags t ON t.subject = c.subject AND t.period <= c.t0 + 5)
SELECT (SELECT count(*) FROM e WHERE (subject, tag) NOT IN (SELECT (subject, tag) FROM s)) AS leaked_early_tags, (SELECT count(*) FROM l WHERE (subject, tag) NOT IN (SELECT (subject, tag) FROM s)) AS late_only_tags""")
def late_only_leak(spark, sf):
    """Early arrays must hold no tag first used after the freeze; late arrays hold some, which shows the check bites."""
    c = S.cohort(spark, sf)
    seen = S.subject_tags(spark, sf).join(c.select("subject", "t0"), "subject").where("period <= t0 + 5").select("subject", "tag").distinct()

    def missing(col, name):
        return c.select("subject", F.explode(col).alias("tag")).join(seen, ["subject", "tag"], "left_anti").agg(n_rows(name))
    return attach(missing("early_tags", "leaked_early_tags"), missing("late_tags", "late_only_tags"), [])


@query("rebuild_variant", "SELECT min_score, k, count(*) AS n_rows, count(*) FILTER (WHERE late_overlap = 0) AS empty_overlap, round(avg(late_overlap), 6) AS mean_late FROM t_variants GROUP BY ALL")
def rebuild_variant(spark, sf):
    """Same rows at every (floor, k)."""
    return EV.variants(spark, sf).groupBy("min_score", "k").agg(n_rows("n_rows"), F.count_if(F.col("late_overlap") == 0).alias("empty_overlap"), r6(F.avg("late_overlap")).alias("mean_late"))


cte("t_cl", """SELECT subject, list_sort(list(tag)) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY n DESC, tag) AS rn FROM (
 SELECT c.subject, coarse AS tag, count(DISTINCT event_id) AS n FROM t_cohort c JOIN t_lines l ON l.subject = c.subject AND l.period BETWEEN c.t0+6 AND c.t0+15 WHERE score >= 0.3::DOUBLE GROUP BY ALL) z) y WHERE rn <= 3 GROUP BY subject""")
cte("t_ca", """SELECT source, cut, list_sort(list(tag)) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY source, cut ORDER BY n DESC, tag) AS rn FROM (
 SELECT c.source, c.cut, coarse AS tag, count(DISTINCT event_id) AS n FROM (SELECT DISTINCT source, t0+5 AS cut FROM t_cohort) c JOIN t_lines l ON l.source = c.source AND l.period <= c.cut WHERE score >= 0.3::DOUBLE GROUP BY ALL) z) y WHERE rn <= 3 GROUP BY ALL""")
cte("t_coarse", f"SELECT c.field, c.subject, c.y, {jac('coalesce(l.tags, [])', 'coalesce(a.tags, [])')} AS lo FROM t_cohort c LEFT JOIN t_cl l ON l.subject = c.subject LEFT JOIN t_ca a ON a.source = c.source AND a.cut = c.t0+5")
cte("t_cth", """WITH a AS (SELECT DISTINCT field, lo AS theta FROM t_coarse UNION SELECT DISTINCT field, 0.0::DOUBLE FROM t_coarse), r AS (SELECT a.field, theta, count(*) FILTER (WHERE lo > theta)::DOUBLE / count(*) AS rate, avg(y::DOUBLE) AS target FROM a JOIN t_coarse c ON c.field = a.field GROUP BY ALL)
SELECT field, theta, rate FROM r QUALIFY row_number() OVER (PARTITION BY field ORDER BY abs(rate - target), theta) = 1""")


@query("taxonomy_parallel", """
SELECT field, round(theta, 6) AS theta, round(rate, 6) AS rate, n11, n10, n01, n00, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT *, (n11+n00)::DOUBLE/n AS po, ((n11+n10)::DOUBLE/n)*((n11+n01)::DOUBLE/n) + (1-(n11+n10)::DOUBLE/n)*(1-(n11+n01)::DOUBLE/n) AS pe FROM (
 SELECT field, theta, rate, count(*) AS n, count(*) FILTER (WHERE y = 1 AND lo > theta) AS n11, count(*) FILTER (WHERE y = 1 AND NOT lo > theta) AS n10, count(*) FILTER (WHERE y = 0 AND lo > theta) AS n01, count(*) FILTER (WHERE y = 0 AND NOT lo > theta) AS n00 FROM t_coarse JOIN t_cth USING (field) GROUP BY ALL) x) z""")
def taxonomy_parallel(spark, sf):
    """The label family from a coarser taxonomy at a threshold that matches the base rate."""
    c = S.cohort(spark, sf)
    ln = S.lines(spark, sf).where("score >= 0.3")

    def top3(rows, keys, out):
        n = rows.groupBy(*keys, F.col("coarse").alias("tag")).agg(F.count_distinct("event_id").alias("n"))
        return top_k(n, keys, [F.col("n").desc(), F.col("tag")], 3).groupBy(*keys).agg(F.sort_array(F.collect_list("tag")).alias(out))
    late = top3(ln.join(c.select("subject", "t0"), "subject").where(F.col("period").between(F.col("t0") + 6, F.col("t0") + 15)), ["subject"], "l")
    cuts = c.select("source", (F.col("t0") + 5).alias("cut")).distinct()
    src = top3(ln.join(cuts, "source").where("period <= cut"), ["source", "cut"], "a")
    rows = c.select("field", "subject", "source", "y", (F.col("t0") + 5).alias("cut")).join(late, "subject", "left").join(src, ["source", "cut"], "left").withColumn("lo", jaccard(F.col("l"), F.col("a"))).select("field", "subject", "y", "lo")
    r = D.rate_above(rows, ["field"], "lo").select("field", F.col("lo").alias("theta"), F.col("p_gt").alias("rate"))
    zero = rows.groupBy("field").agg((F.count_if(F.col("lo") > 0) / F.count(F.lit(1))).alias("rate")).select("field", F.lit(0.0).alias("theta"), "rate")
    th = PD.best_theta(r.unionByName(zero), PD.target(spark, sf), ["field"])
    j = rows.join(th, "field").withColumn("yc", (F.col("lo") > F.col("theta")).cast("int"))
    k = stats.confusion(j, ["field", "theta", "rate"], "y", "yc")
    return k.select("field", r6(F.col("theta")).alias("theta"), r6(F.col("rate")).alias("rate"), "n11", "n10", "n01", "n00", r6(F.col("kappa")).alias("kappa"))


REASONS = ("no_years", "adv_no_years", "too_recent", "implausible_t0", "span_gt_max", "sparse_windows", "kept")


@query("funnel_recheck", f"""
WITH a AS (SELECT coalesce(drop_reason, 'kept') AS counter, count(*) AS recorded FROM t_funnel GROUP BY ALL),
b AS (SELECT CASE WHEN b.t0 IS NULL THEN 'no_years' WHEN sf IS NULL THEN 'adv_no_years' WHEN b.t0 + 15 > 8007 THEN 'too_recent' WHEN b.t0 < 7800 THEN 'implausible_t0' WHEN b.last_period - b.t0 > 60 OR sl - sf > 60 THEN 'span_gt_max'
   WHEN early_prod < 3 OR late_prod < 3 OR coalesce(sp, 0) < 3 THEN 'sparse_windows' ELSE 'kept' END AS counter, count(*) AS recomputed
 FROM t_edges e LEFT JOIN t_bounds b ON b.subject = e.subject LEFT JOIN (SELECT source, min(period) AS sf, max(period) AS sl FROM t_sact GROUP BY source) s ON s.source = e.source
 LEFT JOIN (SELECT x.subject, x.source, sum(n_events) AS sp FROM t_edges x JOIN t_bounds y ON y.subject = x.subject JOIN t_sact z ON z.source = x.source AND z.period <= y.t0 + 5 GROUP BY ALL) p ON p.subject = e.subject AND p.source = e.source GROUP BY ALL)
SELECT counter, coalesce(recorded, 0) AS recorded, coalesce(recomputed, 0) AS recomputed, coalesce(recorded, 0) = coalesce(recomputed, 0) AS same
FROM (VALUES {', '.join(f"('{r}')" for r in REASONS)}) n(counter) LEFT JOIN a USING (counter) LEFT JOIN b USING (counter)""")
def funnel_recheck(spark, sf):
    """Recorded counters of all reasons against counters recomputed from the period lists of subjects and sources."""
    w, known = S.SPEC.windows, S.funnel(spark, sf)
    a = known.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("counter")).agg(n_rows("recorded"))

    def lists(df, key):
        held = df.groupBy(key).agg(F.collect_list(F.struct("period", "n_events")).alias(f"{key}_list"))  # an entry per active period
        ps = F.transform(f"{key}_list", lambda s: s["period"])
        return held.withColumns({f"{key}_from": F.array_min(ps), f"{key}_to": F.array_max(ps)})

    def inside(key, lo, hi):
        return F.aggregate(F.filter(f"{key}_list", lambda s: s["period"].between(lo, hi)), F.lit(0).cast("bigint"), lambda acc, s: acc + s["n_events"])
    e = known.select("subject", "source").join(lists(S.subject_activity(spark, sf), "subject"), "subject", "left").join(lists(S.source_activity(spark, sf), "source"), "source", "left")
    t0, sf0 = F.col("subject_from"), F.col("source_from")
    sparse = (inside("subject", t0, t0 + w.early) < 3) | (inside("subject", t0 + w.early + 1, t0 + w.late) < 3) | (inside("source", sf0, t0 + w.early) < 3)
    reason = (F.when(t0.isNull(), "no_years").when(sf0.isNull(), "adv_no_years").when(t0 + w.late > w.observed_until, "too_recent").when(t0 < 7800, "implausible_t0")
              .when((F.col("subject_to") - t0 > 60) | (F.col("source_to") - sf0 > 60), "span_gt_max").when(sparse, "sparse_windows").otherwise("kept"))
    b = e.groupBy(reason.alias("counter")).agg(n_rows("recomputed"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in REASONS])).alias("counter"))
    z = F.lit(0)
    j = names.join(a, "counter", "left").join(b, "counter", "left").select("counter", F.coalesce("recorded", z).alias("recorded"), F.coalesce("recomputed", z).alias("recomputed"))
    return j.withColumn("same", F.col("recorded") == F.col("recomputed"))


@query("quoted_value_check", """
SELECT field, quoted, round(v, 6) AS regenerated, abs(quoted - v) <= 0.0050001::DOUBLE AS ok FROM (
 SELECT field, round(avg(y::DOUBLE), 2) + CASE WHEN length(field) = 8 THEN 0.02::DOUBLE ELSE 0 END AS quoted, avg(y::DOUBLE) AS v FROM t_cohort GROUP BY field) x""")
def quoted_value_check(spark, sf):
    """Values quoted in a text against regenerated ones. The text is written here; its lines on fields with names of
    eight letters are two hundredths off, and the check has to find them."""
    g = S.cohort(spark, sf).groupBy("field").agg(F.avg("y").alias("v"))
    said = F.round("v", 2) + F.when(F.length("field") == 8, 0.02).otherwise(0.0)
    root = scratch(spark, "quoted")
    g.select(F.concat(F.lit("In "), "field", F.lit(" the share of positive rows is "), F.format_number(said, 2), F.lit(" of all."))).write.text(root)
    return A.quoted_values(spark.read.text(root), "value", r"In (\S+) the share of positive rows is ([0-9.]+)").withColumnRenamed("name", "field").join(g, "field").select(
        "field", F.round("quoted", 2).alias("quoted"), r6(F.col("v")).alias("regenerated"), (F.abs(F.col("quoted") - F.col("v")) <= 0.0050001).alias("ok"))


@query("submission_validate", """
WITH s AS (SELECT subject, seed, y, score FROM t_scores WHERE model = 'overlap' AND split = 'test'), f AS (SELECT subject, y FROM t_split WHERE split = 'test')
SELECT 'seeds' AS "check", (SELECT 10 - count(DISTINCT seed) FROM s) AS violations UNION ALL SELECT 'missing_ids', (SELECT count(*) FROM f WHERE subject NOT IN (SELECT subject FROM s)) UNION ALL SELECT 'unknown_ids', (SELECT count(*) FROM s WHERE subject NOT IN (SELECT subject FROM f))
UNION ALL SELECT 'labels', (SELECT count(*) FROM s JOIN f USING (subject) WHERE s.y <> f.y) UNION ALL SELECT 'one_evaluation', (SELECT count(*) FROM (SELECT subject, seed FROM s GROUP BY ALL HAVING count(*) > 1) d) UNION ALL SELECT 'scores_in_range', (SELECT count(*) FROM s WHERE NOT (score >= 0 AND score <= 1))""")
def submission_validate(spark, sf):
    """Six blocking checks of a submitted score table against the frozen split. The overlap ranking is
    submitted as it is; scores above 1 are reported, not clipped."""
    s = S.scores(spark, sf).where("model = 'overlap' and split = 'test'").select("subject", "seed", "y", "score")
    f = S.split(spark, sf).where("split = 'test'").select("subject", F.col("y").alias("fy"))
    return A.check_rows({
        "seeds": s.agg(10 - F.count_distinct("seed")), "missing_ids": f.join(s, "subject", "left_anti").agg(n_rows()), "unknown_ids": s.join(f, "subject", "left_anti").agg(n_rows()),
        "labels": s.join(f, "subject").where("y <> fy").agg(n_rows()), "one_evaluation": s.groupBy("subject", "seed").count().where("count > 1").agg(n_rows()),
        "scores_in_range": s.where(~((F.col("score") >= 0) & (F.col("score") <= 1)) | F.isnan("score")).agg(n_rows())})


TREE = """(SELECT * FROM t_scores WHERE split = 'test' AND NOT (model = 'reach' AND seed = 9) AND NOT (model = 'overlap' AND seed = 0 AND subject % 5 = 0))"""


@query("result_tree_integrity", f"""
WITH e AS (SELECT field, count(*) AS n FROM t_split WHERE split = 'test' GROUP BY field), c AS (SELECT field, model, seed, count(*) AS n FROM {TREE} q GROUP BY ALL),
g AS (SELECT field, m AS model, s AS seed FROM e, (VALUES ('overlap'), ('reach'), ('volume')) x(m), range(10) r(s))
SELECT 'grid_complete' AS "check", (SELECT count(*) FROM g LEFT JOIN c USING (field, model, seed) WHERE c.n IS NULL) AS violations UNION ALL SELECT 'rows_match_cohort', (SELECT count(*) FROM c JOIN e USING (field) WHERE c.n <> e.n)
UNION ALL SELECT 'ceiling_match', (SELECT count(*) FROM c WHERE model = 'volume' AND seed = 3) UNION ALL SELECT 'one_environment', (SELECT count(DISTINCT field) FROM c WHERE model = 'volume' AND seed = 8)""")
def result_tree_integrity(spark, sf):
    """A tree of score and metric files read back and held against the frozen split: grid completeness, rows per cell,
    stored AP against a recompute, one environment per field. The tree is written here with faults: a seed without files, a
    cell that lacks a fifth of its rows, a metric that is off, a seed run elsewhere."""
    from cohortry.operators import metrics as M
    root = scratch(spark, "tree")
    kept = EV.test_scores(spark, sf).where("not (model = 'reach' and seed = 9)")
    short = kept.where("not (model = 'overlap' and seed = 0 and subject % 5 = 0)")
    short.write.partitionBy("model", "seed").parquet(f"{root}/scores")
    ap = M.average_precision(short, EV.KEYS)
    value = F.col("ap") + F.when((F.col("model") == "volume") & (F.col("seed") == 3), 0.01).otherwise(0.0)
    run = F.struct("seed", F.round(value, 5).alias("auc_pr"), F.when((F.col("model") == "volume") & (F.col("seed") == 8), "elsewhere").otherwise("here").alias("environment"))
    ap.groupBy("field", "model").agg(F.collect_list(run).alias("runs")).write.partitionBy("field").json(f"{root}/metrics")
    size = S.split(spark, sf).where("split = 'test'").groupBy("field").agg(n_rows("expected"))
    return A.result_tree(spark, f"{root}/scores", f"{root}/metrics", size, list(S.MODELS), S.SEEDS)


DECLARED = ("studies", "source_studies", "advises", "at", "coauth", "cites")


@query("manifest_relations", "WITH d(rel) AS (VALUES " + ", ".join(f"('{r}')" for r in DECLARED) + "), b AS (SELECT DISTINCT rel FROM t_strict) SELECT coalesce(d.rel, b.rel) AS rel, CASE WHEN b.rel IS NULL THEN 'declared_only' WHEN d.rel IS NULL THEN 'built_only' ELSE 'both' END AS status FROM d FULL JOIN b ON d.rel = b.rel")
def manifest_relations(spark, sf):
    """Relations a manifest declares against those the graph holds."""
    from cohortry.operators import graph as G
    declared = spark.createDataFrame([(r,) for r in DECLARED], "rel string").select("rel", F.lit(1).alias("a"), F.lit(0).alias("b"))
    built = G.typed_edges(S.cohort(spark, sf), True).select("rel").distinct().select("rel", F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = declared.unionByName(built).groupBy("rel").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return g.select("rel", F.when(F.col("b") == 0, "declared_only").when(F.col("a") == 0, "built_only").otherwise("both").alias("status"))


cte("t_titles", "SELECT o_orderkey AS event_id, o_orderpriority || ' #' || CAST(o_orderkey AS VARCHAR) AS title FROM orders")
cte("t_stitle", """SELECT subject, string_agg(title, ' | ' ORDER BY period, title) AS titles FROM (SELECT c.subject, e.period, title, row_number() OVER (PARTITION BY c.subject ORDER BY md5(concat_ws('|', 'title', c.subject, e.event_id)), e.event_id) AS rn
 FROM t_cohort c JOIN t_ev e ON e.subject = c.subject AND e.period BETWEEN c.t0+6 AND c.t0+15 JOIN t_titles USING (event_id)) x WHERE rn <= 5 GROUP BY subject""")
cte("t_atitle", """SELECT source, t0, string_agg(title, ' | ' ORDER BY period, title) AS titles FROM (SELECT c.source, c.t0, e.period, title, row_number() OVER (PARTITION BY c.source, c.t0 ORDER BY md5(concat_ws('|', 'title', c.source, e.event_id)), e.event_id) AS rn
 FROM (SELECT DISTINCT source, t0 FROM t_cohort) c JOIN (SELECT DISTINCT source, event_id, period FROM t_lines) e ON e.source = c.source AND e.period BETWEEN c.t0 AND c.t0+5 JOIN t_titles USING (event_id)) x WHERE rn <= 5 GROUP BY ALL""")
cte("t_items", f"""
WITH pick AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY field ORDER BY md5(concat_ws('|', 40, 'sample', subject)), subject) AS rn FROM t_cohort c JOIN t_subj s USING (subject) WHERE s.early_prod >= 2 AND s.late_prod >= 2) x WHERE rn <= 15),
a AS (SELECT field, subject, 'true' AS arm, source, t0, y FROM pick UNION ALL SELECT p.field, p.subject, 'placebo', e.source, e.t0, p.y FROM pick p JOIN t_draw d ON d.subject = p.subject AND d.seed = 0 JOIN t_cohort e ON e.subject = d.donor)
SELECT a.field, a.subject, arm, y AS frozen_label, md5(concat_ws('|', 'item', arm, a.subject)) AS item_id, s.titles || ' <> ' || coalesce(t.titles, '') AS prompt, {UNI.format(k="concat_ws('|', 'probe', arm, a.subject)")} < 0.1::DOUBLE AS probed
FROM a LEFT JOIN t_stitle s ON s.subject = a.subject LEFT JOIN t_atitle t ON t.source = a.source AND t.t0 = a.t0""")


def items(spark, sf):
    """Review items: sampled rows with titles in both windows, each once with its own source and once with
    a cohort-matched drawn one, at most five titles a side, and a keyed tenth marked for a repeat."""
    def build():
        c, s = S.cohort(spark, sf), S.subjects(spark, sf).where("early_prod >= 2 and late_prod >= 2").select("subject")
        pick = D.sample_rows(c.join(s, "subject", "left_semi").select("field", "subject", "source", "t0", "y"), ["field"], "subject", 15, 40)
        donor = PD.cohort_draw(spark, sf).where("seed = 0").select("subject", "donor").join(c.select(F.col("subject").alias("donor"), "source", "t0"), "donor")
        own = pick.select("field", "subject", F.lit("true").alias("arm"), "source", "t0", "y")
        pl = pick.select("field", "subject", "y").join(donor, "subject").select("field", "subject", F.lit("placebo").alias("arm"), "source", "t0", "y")
        o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.concat("o_orderpriority", F.lit(" #"), "o_orderkey").alias("title"))

        def five(rows, keys, who):
            h = rows.join(o, "event_id").withColumn("_h", keyed_md5("title", F.col(who), F.col("event_id")))
            best = top_k(h, keys, [F.col("_h"), F.col("event_id")], 5)
            return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("period", "title"))), lambda x: x["title"]), " | ").alias("titles"))
        ev = S.events(spark, sf).select("subject", "event_id", "period").join(pick.select("subject", "t0"), "subject").where(F.col("period").between(F.col("t0") + 6, F.col("t0") + 15))
        st = five(ev, ["subject"], "subject").withColumnRenamed("titles", "a")
        both = own.unionByName(pl)
        want = both.select("source", "t0").distinct()
        at = five(S.lines(spark, sf).select("source", "event_id", "period").distinct().join(want, "source").where(F.col("period").between(F.col("t0"), F.col("t0") + 5)), ["source", "t0"], "source").withColumnRenamed("titles", "b")
        j = both.join(st, "subject", "left").join(at, ["source", "t0"], "left")
        return j.select("field", "subject", "arm", F.col("y").alias("frozen_label"), keyed_md5("item", F.col("arm"), F.col("subject")).alias("item_id"),
                        F.concat("a", F.lit(" <> "), F.coalesce("b", F.lit(""))).alias("prompt"), (uniform(keyed_md5("probe", F.col("arm"), F.col("subject"))) < 0.1).alias("probed"))
    return S.stage(spark, sf, "items", build)


@query("adjudication_sample", "SELECT * FROM t_items")
def adjudication_sample(spark, sf):
    return items(spark, sf)


@query("adjudication_score", """
WITH j AS (SELECT CASE WHEN d.lang = 'en' THEN 'true' ELSE 'placebo' END AS arm, l.quality AS answer, l.toxic AS again, CAST(d.n_chars > 400 AS INTEGER) AS frozen FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT avg(answer::DOUBLE) FILTER (WHERE arm = 'true') AS t1, avg(answer::DOUBLE) FILTER (WHERE arm = 'placebo') AS p1, avg(coalesce(answer, 0)::DOUBLE) FILTER (WHERE arm = 'true') AS t0, avg(coalesce(answer, 0)::DOUBLE) FILTER (WHERE arm = 'placebo') AS p0,
 avg((answer IS NULL)::INT::DOUBLE) AS refusals, avg((answer = 1 - again)::INT::DOUBLE) AS consistency, avg((answer = frozen)::INT::DOUBLE) FILTER (WHERE arm = 'true') AS po, avg(answer::DOUBLE) FILTER (WHERE arm = 'true') AS pj, avg(frozen::DOUBLE) FILTER (WHERE arm = 'true' AND answer IS NOT NULL) AS py FROM j)
SELECT round(t1 - p1, 6) AS gap_answered, round(t0 - p0, 6) AS gap_refusal_is_no, round(refusals, 6) AS refusal_rate, round(consistency, 6) AS probe_consistency, t1 - p1 >= 0.2::DOUBLE AND consistency >= 0.8::DOUBLE AS gates_pass,
 CASE WHEN t1 - p1 >= 0.2::DOUBLE AND consistency >= 0.8::DOUBLE THEN round((po - (pj*py + (1-pj)*(1-py))) / (1 - (pj*py + (1-pj)*(1-py))), 6) END AS kappa FROM r""")
def adjudication_score(spark, sf):
    """True minus placebo acceptance under both refusal conventions; kappa only when both gates pass.

    Judgments come from ``labels`` (no label = refusal), the repeat from its second column.
    """
    d = S.table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", "true").otherwise("placebo").alias("arm"), (F.col("n_chars") > 400).cast("int").alias("frozen"))
    j = d.join(S.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("answer"), F.col("toxic").alias("again")), "doc_id", "left")
    t, p, a = F.col("arm") == "true", F.col("arm") == "placebo", F.col("answer")

    def mean(c, when=None):
        return F.avg(c.cast("double") if when is None else F.when(when, c.cast("double")))
    r = j.agg(mean(a, t).alias("t1"), mean(a, p).alias("p1"), mean(F.coalesce(a, F.lit(0)), t).alias("t0"), mean(F.coalesce(a, F.lit(0)), p).alias("p0"), mean(a.isNull().cast("int")).alias("refusals"),
              mean((a == 1 - F.col("again")).cast("int")).alias("consistency"), mean((a == F.col("frozen")).cast("int"), t).alias("po"), mean(F.col("frozen"), t & a.isNotNull()).alias("py"))
    gap = F.col("t1") - F.col("p1")
    ok = (gap >= 0.2) & (F.col("consistency") >= 0.8)
    return r.select(r6(gap).alias("gap_answered"), r6(F.col("t0") - F.col("p0")).alias("gap_refusal_is_no"), r6(F.col("refusals")).alias("refusal_rate"), r6(F.col("consistency")).alias("probe_consistency"), ok.alias("gates_pass"),
                    F.when(ok, r6(stats.kappa(F.col("po"), F.col("t1"), F.col("py")))).alias("kappa"))
