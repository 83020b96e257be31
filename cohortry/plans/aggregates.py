"""Aggregations over profiles, cohorts, outcomes and graphs."""

from pyspark.sql import Window as W, functions as F

from cohortry.functions.columns import jaccard, r6, render
from cohortry.operators import cohort as C, impact, peers, profiles, stats, typicality as Y
from cohortry.operators.ordering import attach, quantiles, top_k
from cohortry.plans import joins as J, stages as S
from cohortry.plans.joins import jac
from cohortry.plans.registry import cte, query


def n_rows(name="n"):
    return F.count(F.lit(1)).alias(name)


def early_late(spark, sf, ties="first"):
    t0 = F.col("t0")
    return profiles.windowed_profiles(S.subject_tags(spark, sf), S.subjects(spark, sf).select("subject", "t0"), "subject",
                                      {"early": (t0, t0 + 5), "late": (t0 + 6, t0 + 15)}, 10, ties)


@query("topk_profile", "SELECT subject, win, array_to_string(tags, '; ') AS tags, breadth FROM t_sprof")
def topk_profile(spark, sf):
    return early_late(spark, sf).select("subject", "win", render(F.col("tags")).alias("tags"), F.col("tags_breadth").alias("breadth"))


@query("topk_profile_lex", """
SELECT subject, win, array_to_string(list_sort(list(tag)), '; ') AS tags FROM
(SELECT *, row_number() OVER (PARTITION BY subject, win ORDER BY n DESC, tag) AS rn FROM t_stagn) x WHERE rn <= 10 GROUP BY ALL""")
def topk_profile_lex(spark, sf):
    return early_late(spark, sf, "name").select("subject", "win", render(F.col("tags")).alias("tags"))


@query("productivity_breadth", "SELECT subject, early_prod, early_breadth, late_prod, late_breadth FROM t_subj")
def productivity_breadth(spark, sf):
    """Events count even when no tag of theirs passes the score floor."""
    return S.subjects(spark, sf).select("subject", "early_prod", "early_breadth", "late_prod", "late_breadth")


@query("career_bounds", """
SELECT c.subject, c.t0, b.last_period, b.last_period - c.t0 AS span, c.source_age FROM t_cohort c JOIN t_bounds b USING (subject)""")
def career_bounds(spark, sf):
    b = S.subjects(spark, sf).select("subject", "last_period")
    return S.cohort(spark, sf).join(b, "subject").select("subject", "t0", "last_period", (F.col("last_period") - F.col("t0")).alias("span"), "source_age")


@query("set_overlap", f"""
SELECT subject, round({jac('early_tags', 'source_tags')}, 6) AS early_source, round({jac('late_tags', 'source_tags')}, 6) AS late_source,
       round({jac('late_tags', 'early_tags')}, 6) AS late_early FROM t_cohort""")
def set_overlap(spark, sf):
    e, s, l = F.col("early_tags"), F.col("source_tags"), F.col("late_tags")
    return S.cohort(spark, sf).select("subject", r6(jaccard(e, s)).alias("early_source"), r6(jaccard(l, s)).alias("late_source"), r6(jaccard(l, e)).alias("late_early"))


THETAS = (0.1, 0.15, 0.2, 0.25, 0.3)
THETA_SQL = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in THETAS) + ") th(theta)"


def theta_array():
    return F.array(*[F.lit(t) for t in THETAS])


@query("label_threshold", f"""
SELECT field, theta, count(*) AS n, round(avg(({jac('late_tags', 'source_tags')} > theta)::INT::DOUBLE), 6) AS base_rate FROM t_cohort, {THETA_SQL} GROUP BY ALL""")
def label_threshold(spark, sf):
    """Base rate under a grid of thresholds: every row is read once and carries its own labels."""
    j = jaccard(F.col("late_tags"), F.col("source_tags"))
    rows = S.cohort(spark, sf).select("field", j.alias("j")).groupBy("field", "j").agg(n_rows("w"))
    return (rows.withColumn("theta", F.explode(theta_array())).groupBy("field", "theta").agg(
        F.sum("w").alias("n"), r6(F.sum(F.when(F.col("j") > F.col("theta"), F.col("w")).otherwise(0)) / F.sum("w")).alias("base_rate")))


@query("subject_dedupe", "SELECT subject, source, early_prod FROM t_cohort")
def subject_dedupe(spark, sf):
    return C.one_row_per_subject(S.funnel(spark, sf).where(F.col("drop_reason").isNull()), ["source", "early_prod"])


cte("t_hhi", """SELECT b.subject, coalesce(h, 1.0::DOUBLE) AS concentration FROM t_bounds b LEFT JOIN
 (SELECT subject, sum(n::DOUBLE * n) / (sum(n)::DOUBLE * sum(n)) AS h FROM t_stagn WHERE win = 'early' GROUP BY subject) x USING (subject)""")


def early_concentration(spark, sf):
    t = S.subject_tags(spark, sf).join(S.subjects(spark, sf).select("subject", "t0"), "subject").where(F.col("period") <= F.col("t0") + 5)
    h = Y.concentration(profiles.tag_counts(t, ["subject"]), ["subject"])
    return S.subjects(spark, sf).select("subject").join(h, "subject", "left").select("subject", F.coalesce("concentration", F.lit(1.0)).alias("concentration"))


@query("concentration_hhi", "SELECT subject, round(concentration, 6) AS concentration FROM t_hhi")
def concentration_hhi(spark, sf):
    return early_concentration(spark, sf).select("subject", r6(F.col("concentration")).alias("concentration"))


cte("t_gtop", """SELECT field, list_sort(list(tag)) AS frequent FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, tag) AS rn FROM (SELECT field, tag, count(*) AS n FROM (SELECT field, unnest(early_tags) AS tag FROM t_cohort) x GROUP BY ALL) z) y WHERE rn <= 10 GROUP BY field""")
cte("t_stop", """SELECT field, list_sort(list(tag)) AS frequent FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, tag) AS rn FROM (SELECT field, tag, count(*) AS n FROM (SELECT field, unnest(source_tags) AS tag FROM t_cohort) x GROUP BY ALL) z) y WHERE rn <= 10 GROUP BY field""")
cte("t_ctop", """SELECT field, t0, list_sort(list(tag)) AS frequent FROM (SELECT *, row_number() OVER (PARTITION BY field, t0 ORDER BY n DESC, tag) AS rn FROM (
 SELECT x.field, t.t0, tag, count(*) AS n FROM (SELECT field, t0, unnest(early_tags) AS tag FROM t_cohort) x JOIN (SELECT DISTINCT field, t0 FROM t_cohort) t ON x.field = t.field AND abs(x.t0 - t.t0) <= 3 GROUP BY ALL) z) y
 WHERE rn <= 10 GROUP BY ALL""")


@query("global_typicality", f"SELECT subject, round({jac('early_tags', 'frequent')}, 6) AS typicality FROM t_cohort JOIN t_gtop USING (field)")
def global_typicality(spark, sf):
    return Y.typicality(S.cohort(spark, sf), ["field"], "early_tags", "early_tags", "t").select("subject", r6(F.col("t")).alias("typicality"))


@query("cohort_typicality", f"SELECT subject, round({jac('early_tags', 'frequent')}, 6) AS typicality FROM t_cohort JOIN t_ctop USING (field, t0)")
def cohort_typicality(spark, sf):
    return Y.cohort_typicality(S.cohort(spark, sf), ["field"], "t0", "early_tags", "t").select("subject", r6(F.col("t")).alias("typicality"))


@query("generic_profile_overlap", f"SELECT subject, round({jac('early_tags', 'frequent')}, 6) AS overlap FROM t_cohort JOIN t_stop USING (field)")
def generic_profile_overlap(spark, sf):
    return Y.typicality(S.cohort(spark, sf), ["field"], "early_tags", "source_tags", "t").select("subject", r6(F.col("t")).alias("overlap"))


cte("t_peers", """
SELECT i.subject, count(j.subject) FILTER (WHERE j.t0 <= i.t0) AS peer_n_prior,
  coalesce((sum(j.early_overlap::DECIMAL(18,6)) FILTER (WHERE j.t0 <= i.t0))::DOUBLE / (count(j.subject) FILTER (WHERE j.t0 <= i.t0)), -1) AS peer_overlap_mean, coalesce(avg(j.early_prod::DOUBLE) FILTER (WHERE j.t0 <= i.t0), -1) AS peer_prod_mean,
  coalesce(avg(j.early_breadth::DOUBLE) FILTER (WHERE j.t0 <= i.t0), -1) AS peer_breadth_mean, coalesce(avg(j.y::DOUBLE) FILTER (WHERE j.t0 + 10 <= i.t0), -1) AS peer_track_record,
  count(j.subject) FILTER (WHERE j.t0 + 10 <= i.t0) AS peer_n_closed
FROM t_cohort i LEFT JOIN t_cohort j ON j.source = i.source AND j.subject <> i.subject GROUP BY i.subject""")


@query("peer_aggregates", "SELECT * FROM t_peers")
def peer_aggregates(spark, sf):
    """Sums are exact decimals, so the means need no rounding to be the same on any layout."""
    p = peers.peer_aggregates(S.cohort(spark, sf).select("subject", "source", "t0", "early_overlap", "early_prod", "early_breadth", "y"))
    return p.select("subject", "peer_n_prior", "peer_overlap_mean", "peer_prod_mean", "peer_breadth_mean", "peer_track_record", "peer_n_closed")


@query("source_fanout", "SELECT i.subject, count(j.subject) AS fanout FROM t_cohort i LEFT JOIN t_cohort j ON j.source = i.source AND j.t0 < i.t0 GROUP BY i.subject")
def source_fanout(spark, sf):
    """Subjects the same source already had strictly earlier."""
    return peers.peer_sums(S.cohort(spark, sf).select("subject", "source", "t0"), ["source"], "t0", [], -1, "f_").select("subject", F.col("f_n").alias("fanout"))


@query("h_index", "SELECT subject, h_index FROM t_hindex")
def h_index(spark, sf):
    return impact.h_index(S.events(spark, sf), "subject", "cites")


@query("late_impact_mean", "SELECT subject, late_pct_mean, late_n FROM t_late")
def late_impact_mean(spark, sf):
    return J.late_impact(spark, sf)


@query("funnel_counts", """
SELECT coalesce(field, '(all)') AS field, coalesce(reason, '(all)') AS reason, count(*) AS n FROM (SELECT field, coalesce(drop_reason, 'kept') AS reason FROM t_funnel) x GROUP BY ROLLUP(field, reason)""")
def funnel_counts(spark, sf):
    f = S.funnel(spark, sf).select("field", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))
    return f.rollup("field", "reason").agg(n_rows()).select(F.coalesce("field", F.lit("(all)")).alias("field"), F.coalesce("reason", F.lit("(all)")).alias("reason"), "n")


@query("funnel_coverage", """
SELECT f.field, count(*) AS raw_pairs, count(*) FILTER (WHERE a.aid IS NOT NULL AND s.aid IS NOT NULL) AS both_resolvable,
 count(*) FILTER (WHERE drop_reason IS NULL) AS survive, count(DISTINCT f.subject) FILTER (WHERE drop_reason IS NULL) AS modelled,
 round(avg((a.aid IS NOT NULL)::INT::DOUBLE), 6) AS source_coverage, round(avg((s.aid IS NOT NULL)::INT::DOUBLE), 6) AS subject_coverage
FROM t_funnel f LEFT JOIN t_resolved a ON a.pid = CAST(f.source AS VARCHAR) LEFT JOIN t_resolved s ON s.pid = CAST(f.subject AS VARCHAR) GROUP BY f.field""")
def funnel_coverage(spark, sf):
    """Raw -> resolvable -> surviving -> modelled, with coverage of both ends."""
    r = J.resolved(spark, sf).select("pid", F.col("aid").isNotNull().cast("int").alias("ok"))
    f = (S.funnel(spark, sf).withColumn("ps", F.col("subject").cast("string")).withColumn("pa", F.col("source").cast("string"))
         .join(r.select(F.col("pid").alias("ps"), F.col("ok").alias("s")), "ps", "left").join(r.select(F.col("pid").alias("pa"), F.col("ok").alias("a")), "pa", "left"))
    z = F.lit(0)
    kept = F.col("drop_reason").isNull()
    return f.groupBy("field").agg(
        n_rows("raw_pairs"), F.count_if((F.coalesce("a", z) == 1) & (F.coalesce("s", z) == 1)).alias("both_resolvable"), F.count_if(kept).alias("survive"),
        F.count_distinct(F.when(kept, F.col("subject"))).alias("modelled"), r6(F.avg(F.coalesce("a", z))).alias("source_coverage"), r6(F.avg(F.coalesce("s", z))).alias("subject_coverage"))


@query("funnel_from_years", """
SELECT CASE WHEN t0 + 15 > 8007 THEN 'too_recent' WHEN last_period - t0 > 60 THEN 'span_gt_max' WHEN early_prod < 3 OR late_prod < 3 THEN 'sparse_windows' ELSE 'kept' END AS reason, count(*) AS n
FROM t_bounds GROUP BY ALL""")
def funnel_from_years(spark, sf):
    """The cascade from period lists alone (one (period, count) entry per distinct period)."""
    lists = S.subject_activity(spark, sf).groupBy("subject").agg(F.collect_list(F.struct("period", "n_events")).alias("a"))
    lists = lists.withColumn("t0", F.array_min(F.transform("a", lambda s: s["period"]))).withColumn("last", F.array_max(F.transform("a", lambda s: s["period"])))

    def inside(lo, hi):
        return F.aggregate(F.filter("a", lambda s: s["period"].between(lo, hi)), F.lit(0).cast("bigint"), lambda acc, s: acc + s["n_events"])
    t0 = F.col("t0")
    reason = (F.when(t0 + 15 > S.SPEC.windows.observed_until, "too_recent").when(F.col("last") - t0 > 60, "span_gt_max")
              .when((inside(t0, t0 + 5) < 3) | (inside(t0 + 6, t0 + 15) < 3), "sparse_windows").otherwise("kept"))
    return lists.groupBy(reason.alias("reason")).agg(n_rows())


@query("base_rate_by", """
SELECT coalesce(field, '(all)') AS field, coalesce(split, '(all)') AS split, count(*) AS n, round(avg(y::DOUBLE), 6) AS base_rate FROM t_split GROUP BY GROUPING SETS ((field, split), (field), (split), ())""")
def base_rate_by(spark, sf):
    a = F.lit("(all)")
    return S.split(spark, sf).cube("field", "split").agg(n_rows(), r6(F.avg("y")).alias("base_rate")).select(
        F.coalesce("field", a).alias("field"), F.coalesce("split", a).alias("split"), "n", "base_rate")


@query("decade_trend", """
SELECT bin, n, round(p, 6) AS rate, round(greatest(p - 1.96::DOUBLE*sqrt(p*(1-p)/n), 0), 6) AS lo, round(p + 1.96::DOUBLE*sqrt(p*(1-p)/n), 6) AS hi, round(r, 6) AS corr_overlap_y, round(i, 6) AS interaction_rate
FROM (SELECT t0//4*4 AS bin, count(*) AS n, avg(y::DOUBLE) AS p, covar_pop(early_overlap, y::DOUBLE) / nullif(stddev_pop(early_overlap) * stddev_pop(y::DOUBLE), 0) AS r, avg(interacted::INT::DOUBLE) AS i FROM t_cohort GROUP BY ALL HAVING count(*) >= 10) x""")
def decade_trend(spark, sf):
    """Trend over calendar bins with at least ten rows (four quarters per bin)."""
    t = (S.cohort(spark, sf).groupBy(F.expr("cast(t0 div 4 * 4 as int)").alias("bin")).agg(
        n_rows(), F.avg("y").alias("p"), stats.corr(F.col("early_overlap"), F.col("y")).alias("r"), F.avg(F.col("interacted").cast("double")).alias("i")).where("n >= 10"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return t.select("bin", "n", r6(F.col("p")).alias("rate"), r6(F.greatest(F.col("p") - half, F.lit(0.0))).alias("lo"), r6(F.col("p") + half).alias("hi"),
                    r6(F.col("r")).alias("corr_overlap_y"), r6(F.col("i")).alias("interaction_rate"))


@query("population_share_by_decade", """
SELECT bin, tag, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY bin), 6) AS share FROM (SELECT CAST(period//8*8 AS INTEGER) AS bin, tag, count(*) AS n FROM t_stags GROUP BY ALL) x
QUALIFY row_number() OVER (PARTITION BY bin ORDER BY n DESC, tag) <= 25""")
def population_share_by_decade(spark, sf):
    """Shares of tags per calendar bin, top 25 members."""
    c = S.subject_tags(spark, sf).groupBy(F.expr("cast(period div 8 * 8 as int)").alias("bin"), "tag").agg(n_rows())
    tot = c.groupBy("bin").agg(F.sum("n").alias("total"))
    return top_k(c.join(tot, "bin").withColumn("share", r6(F.col("n") / F.col("total"))), ["bin"], [F.col("n").desc(), F.col("tag")], 25).select("bin", "tag", "n", "share")


@query("axis_rank", """
SELECT field, round(rate, 6) AS rate, CAST(rank() OVER (ORDER BY rate) AS INTEGER) AS place, round(max(rate) OVER () / min(rate) OVER (), 6) AS max_min_ratio
FROM (SELECT field, avg(interacted::INT::DOUBLE) AS rate FROM t_cohort GROUP BY field) x""")
def axis_rank(spark, sf):
    """One row per field, so the unpartitioned window holds the fields only."""
    r = S.cohort(spark, sf).groupBy("field").agg(F.avg(F.col("interacted").cast("double")).alias("rate"))
    w = W.partitionBy(F.lit(0))
    return r.select("field", r6(F.col("rate")).alias("rate"), F.rank().over(w.orderBy("rate")).alias("place"), r6(F.max("rate").over(w) / F.min("rate").over(w)).alias("max_min_ratio"))


cte("t_terc", """
SELECT c.*, CASE WHEN early_prod <= q1 THEN 'low' WHEN early_prod <= q2 THEN 'mid' ELSE 'high' END AS stratum FROM t_cohort c
JOIN (SELECT field, quantile_cont(early_prod, 1.0::DOUBLE/3) AS q1, quantile_cont(early_prod, 2.0::DOUBLE/3) AS q2 FROM t_cohort GROUP BY field) q USING (field)""")


def terciles(df, group, value, out="stratum"):
    return stats.quantile_label(df, group, value, [1 / 3, 2 / 3], ["low", "mid", "high"], out)


@query("stratified_rate_terciles", """
SELECT stratum, field, n, round(rate, 6) AS rate, lo, hi, rate = min(rate) OVER (PARTITION BY stratum) AS lowest,
 round(coalesce(lead(rate) OVER (PARTITION BY stratum ORDER BY rate, field) - rate, 0), 6) AS margin_to_next
FROM (SELECT stratum, field, count(*) AS n, avg(interacted::INT::DOUBLE) AS rate, min(early_prod) AS lo, max(early_prod) AS hi FROM t_terc GROUP BY ALL) x""")
def stratified_rate_terciles(spark, sf):
    """Interaction rate inside within-field terciles, and which field is lowest in each stratum."""
    t = terciles(S.cohort(spark, sf).select("field", "early_prod", "interacted"), ["field"], "early_prod")
    g = t.groupBy("stratum", "field").agg(n_rows(), F.avg(F.col("interacted").cast("double")).alias("rate"), F.min("early_prod").alias("lo"), F.max("early_prod").alias("hi"))
    w = W.partitionBy("stratum")
    return g.select("stratum", "field", "n", r6(F.col("rate")).alias("rate"), "lo", "hi", (F.col("rate") == F.min("rate").over(w)).alias("lowest"),
                    r6(F.coalesce(F.lead("rate").over(w.orderBy("rate", "field")) - F.col("rate"), F.lit(0.0))).alias("margin_to_next"))


@query("density_strata", """
WITH j AS (SELECT c.field, interacted, density FROM t_cohort c JOIN t_density USING (institution)),
q AS (SELECT field, quantile_cont(density, 1.0::DOUBLE/3) AS q1, quantile_cont(density, 2.0::DOUBLE/3) AS q2 FROM j GROUP BY field)
SELECT field, CASE WHEN density <= q1 THEN 'low' WHEN density <= q2 THEN 'mid' ELSE 'high' END AS stratum, count(*) AS n, round(avg(interacted::INT::DOUBLE), 6) AS rate, round(min(density), 6) AS lo, round(max(density), 6) AS hi
FROM j JOIN q USING (field) GROUP BY ALL""")
def density_strata(spark, sf):
    j = S.cohort(spark, sf).select("field", "institution", "interacted").join(J.density(spark, sf), "institution")
    return terciles(j, ["field"], "density").groupBy("field", "stratum").agg(
        n_rows(), r6(F.avg(F.col("interacted").cast("double"))).alias("rate"), r6(F.min("density")).alias("lo"), r6(F.max("density")).alias("hi"))


cte("t_eo", "SELECT c.field, c.subject, c.source, c.institution, c.t0, c.early_overlap, c.early_prod, c.y, c.interacted, o.late_pct_mean, o.h_index FROM t_cohort c JOIN t_outcomes o USING (subject) WHERE late_pct_mean IS NOT NULL")


def with_outcomes(spark, sf):
    o = J.outcomes(spark, sf).where(F.col("late_pct_mean").isNotNull()).select("subject", "late_pct_mean", "h_index")
    return S.cohort(spark, sf).select("field", "subject", "source", "institution", "t0", "early_overlap", "early_prod", "early_breadth", "y", "interacted").join(o, "subject")


@query("quintile_outcome", """
WITH q AS (SELECT list_distinct([quantile_cont(early_overlap, 0.0), quantile_cont(early_overlap, 0.2), quantile_cont(early_overlap, 0.4), quantile_cont(early_overlap, 0.6), quantile_cont(early_overlap, 0.8), quantile_cont(early_overlap, 1.0)]) AS e FROM t_eo)
SELECT CAST(greatest(1, len(list_filter(e, lambda v: v < early_overlap))) AS INTEGER) AS bin, count(*) AS n, round(avg(late_pct_mean), 6) AS mean, round(coalesce(stddev_samp(late_pct_mean), 0) / sqrt(count(*)), 6) AS sem
FROM t_eo, q GROUP BY ALL""")
def quintile_outcome(spark, sf):
    b = stats.quantile_bin(with_outcomes(spark, sf), [], "early_overlap", 5, "bin")
    return b.groupBy("bin").agg(n_rows(), r6(F.avg("late_pct_mean")).alias("mean"), r6(F.coalesce(F.stddev_samp("late_pct_mean"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("sem"))


cte("t_links", """
SELECT c.field, c.subject, c.source, coalesce(s.n, 0) AS sl, coalesce(a.n, 0) AS al, coalesce(b.n, 0) AS joint FROM t_cohort c
LEFT JOIN (SELECT subject, count(DISTINCT event_id) AS n FROM t_lines GROUP BY ALL) s ON s.subject = c.subject
LEFT JOIN (SELECT source, count(DISTINCT event_id) AS n FROM t_lines GROUP BY ALL) a ON a.source = c.source
LEFT JOIN (SELECT subject, source, count(DISTINCT event_id) AS n FROM t_lines GROUP BY ALL) b ON b.subject = c.subject AND b.source = c.source""")


@query("link_coverage_stats", """
SELECT field, round(avg(sl::DOUBLE), 6) AS subject_mean, quantile_cont(sl::DOUBLE, 0.5) AS subject_median, round(avg(al::DOUBLE), 6) AS source_mean, quantile_cont(al::DOUBLE, 0.5) AS source_median,
 round(avg((sl > 0 AND al > 0)::INT::DOUBLE), 6) AS both_linkable, round(avg((joint > 0)::INT::DOUBLE), 6) AS raw_rate, round(avg((joint > 0)::INT::DOUBLE) FILTER (WHERE sl > 0 AND al > 0), 6) AS conditioned_rate FROM t_links GROUP BY field""")
def link_coverage_stats(spark, sf):
    ok = S.lines(spark, sf)

    def links(keys, name):
        return ok.groupBy(*keys).agg(F.count_distinct("event_id").alias(name))
    z = F.lit(0)
    j = (S.cohort(spark, sf).select("field", "subject", "source").join(links(["subject"], "sl"), "subject", "left").join(links(["source"], "al"), "source", "left")
         .join(links(["subject", "source"], "joint"), ["subject", "source"], "left")
         .select("field", F.coalesce("sl", z).alias("sl"), F.coalesce("al", z).alias("al"), F.coalesce("joint", z).alias("joint")))
    both, hit = (F.col("sl") > 0) & (F.col("al") > 0), (F.col("joint") > 0).cast("int")
    a = j.groupBy("field").agg(r6(F.avg("sl")).alias("subject_mean"), r6(F.avg("al")).alias("source_mean"), r6(F.avg(both.cast("int"))).alias("both_linkable"),
                               r6(F.avg(hit)).alias("raw_rate"), r6(F.avg(F.when(both, hit))).alias("conditioned_rate"))
    return a.join(quantiles(j, ["field"], "sl", {"subject_median": 0.5}), "field").join(quantiles(j, ["field"], "al", {"source_median": 0.5}), "field")


@query("tag_level_histogram", """
SELECT coalesce(field, '(pooled)') AS field, level, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY field, grouping(field)), 6) AS share
FROM (SELECT field, coalesce(level, -1) AS level FROM (SELECT field, unnest(early_tags) AS tag FROM t_cohort) x LEFT JOIN t_szlev USING (tag)) y GROUP BY GROUPING SETS ((field, level), (level))""")
def tag_level_histogram(spark, sf):
    from cohortry.plans.filters import size_levels
    t = (S.cohort(spark, sf).select("field", F.explode("early_tags").alias("tag")).groupBy("field", "tag").agg(n_rows("w")).join(size_levels(spark, sf), "tag", "left")
         .select("field", F.coalesce("level", F.lit(-1)).alias("level"), "w"))
    both = t.withColumn("field", F.explode(F.array(F.col("field"), F.lit("(pooled)"))))
    g = both.groupBy("field", "level").agg(F.sum("w").alias("n"))
    return g.select("field", "level", "n", r6(F.col("n") / F.sum("n").over(W.partitionBy("field"))).alias("share"))


@query("tag_earliest", "SELECT tag, min(period) AS first_period FROM t_lines GROUP BY tag")
def tag_earliest(spark, sf):
    return S.lines(spark, sf).groupBy("tag").agg(F.min("period").alias("first_period"))


@query("tag_graph_density", """
WITH a AS (SELECT field, subject, source, unnest(early_tags) AS tag FROM t_cohort), b AS (SELECT field, source, unnest(source_tags) AS tag FROM t_cohort WHERE len(early_tags) > 0)
SELECT field, n_tags, s AS subject_edges, t AS source_edges, round((s + t)::DOUBLE / n_tags, 6) AS mean_degree
FROM (SELECT field, count(DISTINCT tag) AS n_tags FROM (SELECT field, tag FROM a UNION ALL SELECT field, tag FROM b) u GROUP BY field) x
JOIN (SELECT field, count(*) AS s FROM a GROUP BY field) y USING (field) JOIN (SELECT field, count(*) AS t FROM (SELECT DISTINCT field, source, tag FROM b) d GROUP BY field) z USING (field)""")
def tag_graph_density(spark, sf):
    c = S.cohort(spark, sf).where(F.size("early_tags") > 0)
    a = c.select("field", F.explode("early_tags").alias("tag")).groupBy("field", "tag").agg(n_rows("s"))
    b = c.select("field", "source", F.explode("source_tags").alias("tag")).distinct().groupBy("field", "tag").agg(n_rows("t"))
    u = a.join(b, ["field", "tag"], "full")
    g = u.groupBy("field").agg(n_rows("n_tags"), F.coalesce(F.sum("s"), F.lit(0)).alias("subject_edges"), F.coalesce(F.sum("t"), F.lit(0)).alias("source_edges"))
    return g.withColumn("mean_degree", r6((F.col("subject_edges") + F.col("source_edges")) / F.col("n_tags")))


cte("t_degree", """SELECT tag, count(*) AS deg FROM (SELECT unnest(early_tags) AS tag FROM t_cohort UNION ALL SELECT unnest(source_tags) FROM t_cohort) x GROUP BY tag""")
cte("t_rowdeg", """SELECT subject, coalesce(avg(deg::DOUBLE), 0) AS mean_degree FROM (SELECT subject, unnest(CASE WHEN len(early_tags) = 0 THEN [NULL] ELSE early_tags END) AS tag FROM t_split WHERE split = 'test') x
 LEFT JOIN t_degree USING (tag) GROUP BY subject""")


def row_degree(spark, sf):
    c = S.split(spark, sf)
    deg = c.select(F.explode(F.concat("early_tags", "source_tags")).alias("tag")).groupBy("tag").agg(n_rows("deg"))
    return (c.where("split = 'test'").select("subject", "y", "t0", F.explode_outer("early_tags").alias("tag")).join(deg, "tag", "left")
            .groupBy("subject", "y", "t0").agg(F.coalesce(F.avg("deg"), F.lit(0.0)).alias("mean_degree")))


@query("tag_degree_strata", """
SELECT CASE WHEN mean_degree <= q1 THEN 'low' WHEN mean_degree <= q2 THEN 'mid' ELSE 'high' END AS stratum, count(*) AS n, round(avg(mean_degree), 5) AS mean_degree
FROM t_rowdeg, (SELECT quantile_cont(mean_degree, 1.0::DOUBLE/3) AS q1, quantile_cont(mean_degree, 2.0::DOUBLE/3) AS q2 FROM t_rowdeg) q GROUP BY ALL""")
def tag_degree_strata(spark, sf):
    t = terciles(row_degree(spark, sf), [], "mean_degree")
    return t.groupBy("stratum").agg(n_rows(), F.round(F.avg("mean_degree"), 5).alias("mean_degree"))


cte("t_cell", "SELECT *, avg(y::DOUBLE) OVER (PARTITION BY field, split, t0) AS cell_rate FROM t_split")


@query("cell_composition_score", "SELECT subject, round(cell_rate, 6) AS cell_rate FROM t_cell")
def cell_composition_score(spark, sf):
    """Score of a row = base rate of its (split, t0) cell; cells are aggregated, then joined back."""
    return cell_scores(spark, sf).select("subject", r6(F.col("cell_rate")).alias("cell_rate"))


def cell_scores(spark, sf):
    c = S.split(spark, sf).select("field", "split", "t0", "subject", "y")
    return c.join(c.groupBy("field", "split", "t0").agg(F.avg("y").alias("cell_rate")), ["field", "split", "t0"])


@query("dispersion_strata", """
WITH c AS (SELECT field, t0, count(*) AS n, avg(y::DOUBLE) AS r FROM t_split GROUP BY ALL), p AS (SELECT field, avg(y::DOUBLE) AS pooled FROM t_split GROUP BY field),
d AS (SELECT field, t0, n, abs(r - pooled) AS dev FROM c JOIN p USING (field)), m AS (SELECT field, quantile_cont(dev, 0.5) AS cut FROM d GROUP BY field)
SELECT field, CASE WHEN dev <= cut THEN 'low' ELSE 'high' END AS stratum, count(*) AS cells, sum(n)::BIGINT AS n FROM d JOIN m USING (field) GROUP BY ALL""")
def dispersion_strata(spark, sf):
    """Cells whose base rate sits nearest the pooled rate, split at the median deviation over cells."""
    cells = S.split(spark, sf).groupBy("field", "t0").agg(n_rows(), F.sum("y").alias("pos"))
    pooled = cells.groupBy("field").agg((F.sum("pos") / F.sum("n")).alias("pooled"))
    d = cells.join(pooled, "field").withColumn("dev", F.abs(F.col("pos") / F.col("n") - F.col("pooled")))
    l = stats.quantile_label(d, ["field"], "dev", [0.5], ["low", "high"], "stratum")
    return l.groupBy("field", "stratum").agg(n_rows("cells"), F.sum("n").alias("n"))


@query("window_empty_rates", """
SELECT field, count(*) AS n, round(avg((early_breadth = 0)::INT::DOUBLE), 6) AS early_empty, round(avg((late_breadth = 0)::INT::DOUBLE), 6) AS late_empty, quantile_cont((early_breadth + late_breadth)::DOUBLE, 0.5) AS median_tags,
 CASE WHEN greatest(avg((early_breadth = 0)::INT::DOUBLE), avg((late_breadth = 0)::INT::DOUBLE)) < 0.15::DOUBLE THEN 'PASS' ELSE 'FLAG' END AS verdict
FROM t_subj JOIN (SELECT c_custkey AS subject, c_mktsegment AS field FROM customer) c USING (subject) GROUP BY field""")
def window_empty_rates(spark, sf):
    f = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("field"))
    s = S.subjects(spark, sf).join(f, "subject").select("field", (F.col("early_breadth") + F.col("late_breadth")).alias("tags"),
                                                        (F.col("early_breadth") == 0).cast("int").alias("e"), (F.col("late_breadth") == 0).cast("int").alias("l"))
    a = s.groupBy("field").agg(n_rows(), r6(F.avg("e")).alias("early_empty"), r6(F.avg("l")).alias("late_empty"),
                               F.when(F.greatest(F.avg("e"), F.avg("l")) < 0.15, "PASS").otherwise("FLAG").alias("verdict"))
    return a.join(quantiles(s, ["field"], "tags", {"median_tags": 0.5}), "field")


@query("label_decomposition", f"""
SELECT y, count(*) AS n, round(avg(j), 6) AS mean, round(quantile_cont(j, 0.5), 6) AS median, round(quantile_cont(j, 0.25), 6) AS q25, round(quantile_cont(j, 0.75), 6) AS q75, round(avg(sh), 6) AS already_early
FROM (SELECT y, {jac('late_tags', 'early_tags')} AS j, CASE WHEN len(list_intersect(late_tags, source_tags)) > 0 THEN len(list_intersect(list_intersect(late_tags, source_tags), early_tags))::DOUBLE / len(list_intersect(late_tags, source_tags)) END AS sh FROM t_cohort) x GROUP BY y""")
def label_decomposition(spark, sf):
    kept = F.array_intersect("late_tags", "source_tags")
    c = S.cohort(spark, sf).select("y", jaccard(F.col("late_tags"), F.col("early_tags")).alias("j"),
                                   F.when(F.size(kept) > 0, F.size(F.array_intersect(kept, "early_tags")) / F.size(kept)).alias("sh"))
    a = c.groupBy("y").agg(n_rows(), r6(F.avg("j")).alias("mean"), r6(F.avg("sh")).alias("already_early"))
    q = quantiles(c, ["y"], "j", {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return a.join(q, "y").select("y", "n", "mean", *[r6(F.col(k)).alias(k) for k in ("median", "q25", "q75")], "already_early")


def self_labels(spark, sf):
    return S.cohort(spark, sf).select("field", "y", (jaccard(F.col("late_tags"), F.col("early_tags")) > 0.2).cast("int").alias("y_self"))


cte("t_self", f"SELECT field, y, ({jac('late_tags', 'early_tags')} > 0.2::DOUBLE)::INT AS y_self FROM t_cohort")


@query("confusion_kappa", """
SELECT field, n11, n10, n01, n00, round(po, 6) AS agreement, round(CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (
 SELECT *, (n11+n00)::DOUBLE/n AS po, ((n11+n10)::DOUBLE/n)*((n11+n01)::DOUBLE/n) + (1-(n11+n10)::DOUBLE/n)*(1-(n11+n01)::DOUBLE/n) AS pe FROM (
 SELECT field, count(*) AS n, count(*) FILTER (WHERE y=1 AND y_self=1) AS n11, count(*) FILTER (WHERE y=1 AND y_self=0) AS n10, count(*) FILTER (WHERE y=0 AND y_self=1) AS n01, count(*) FILTER (WHERE y=0 AND y_self=0) AS n00 FROM t_self GROUP BY field) x) z""")
def confusion_kappa(spark, sf):
    k = stats.confusion(self_labels(spark, sf), ["field"], "y", "y_self")
    return k.select("field", "n11", "n10", "n01", "n00", r6(F.col("agreement")).alias("agreement"), r6(F.col("kappa")).alias("kappa"))


@query("kappa_reweighted", """
WITH b AS (SELECT avg(quality::DOUBLE) AS base FROM labels), s AS (SELECT doc_id, quality AS y, 1 - toxic AS j, lang FROM labels JOIN documents USING (doc_id)),
m AS (SELECT lang, avg(y::DOUBLE) AS sr, any_value(base) AS base, avg((y=1 AND j=1)::INT::DOUBLE) AS p11, avg((y=0 AND j=0)::INT::DOUBLE) AS p00, avg((y=0 AND j=1)::INT::DOUBLE) AS p01 FROM s, b GROUP BY lang),
w AS (SELECT *, base/greatest(sr, 1e-9) AS w1, (1-base)/greatest(1-sr, 1e-9) AS w0 FROM m),
t AS (SELECT *, w1*sr + w0*(1-sr) AS tot FROM w), k AS (SELECT *, (w1*p11 + w0*p00)/tot AS po, (w1*p11 + w0*p01)/tot AS rj FROM t)
SELECT lang, round(sr, 6) AS sample_rate, round(base, 6) AS cohort_rate, round(CASE WHEN base*rj + (1-base)*(1-rj) >= 1 THEN 1 ELSE (po - (base*rj + (1-base)*(1-rj))) / (1 - (base*rj + (1-base)*(1-rj))) END, 6) AS kappa FROM k""")
def kappa_reweighted(spark, sf):
    """Two judgments per document, weighted per language to the overall base rate."""
    l = S.table(spark, sf, "labels")
    base = l.agg(F.avg("quality").alias("base"))
    d = S.table(spark, sf, "documents").select("doc_id", "lang")
    s = attach(l.join(d, "doc_id").select("lang", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("j")), base, [])
    k = stats.kappa_reweighted(s, ["lang"], "y", "j", "base")
    return k.select("lang", *[r6(F.col(c)).alias(c) for c in ("sample_rate", "cohort_rate", "kappa")])


RANKS = "(rank() OVER (PARTITION BY field ORDER BY {c}) + (count(*) OVER (PARTITION BY field, {c}) - 1) / 2.0::DOUBLE)"


@query("rank_correlation", f"SELECT field, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS rho, count(*) AS n FROM (SELECT field, {RANKS.format(c='early_overlap')} AS a, {RANKS.format(c='late_overlap')} AS b FROM t_cohort) x GROUP BY field")
def rank_correlation(spark, sf):
    s = stats.spearman(S.cohort(spark, sf), ["field"], "early_overlap", "late_overlap")
    return s.select("field", r6(F.col("rho")).alias("rho"), "n")


@query("r2_score", """
SELECT field, round(1 - sum((late_overlap - early_overlap)*(late_overlap - early_overlap)) / nullif(sum(late_overlap*late_overlap) - sum(late_overlap)*sum(late_overlap)/count(*), 0), 6) AS r2 FROM t_cohort GROUP BY field""")
def r2_score(spark, sf):
    return stats.r2(S.cohort(spark, sf), ["field"], "late_overlap", "early_overlap").select("field", r6(F.col("r2")).alias("r2"))


@query("seed_summary", """
SELECT field, model, round(avg(v) + 1e-9::DOUBLE, 6) AS mean, round(coalesce(stddev_samp(v), 0) + 1e-9::DOUBLE, 6) AS sd, count(*) AS n_seeds FROM (SELECT field, model, seed, sum(CAST(score AS DECIMAL(18, 4)))::DOUBLE / count(*) AS v FROM t_scores WHERE split = 'test' GROUP BY ALL) x GROUP BY ALL""")
def seed_summary(spark, sf):
    """Exact decimal sums per seed; halves of the last place go up on both sides."""
    exact = F.sum(F.col("score").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))
    m = S.scores(spark, sf).where("split = 'test'").groupBy("field", "model", "seed").agg(exact.alias("value"))
    return stats.seed_summary(m, ["field", "model"]).select("field", "model", r6(F.col("mean") + 1e-9).alias("mean"), r6(F.col("sd") + 1e-9).alias("sd"), "n_seeds")


@query("nmi_two_labelings", """
WITH c AS (SELECT institution AS a, source AS b, count(*)::DOUBLE AS c FROM t_cohort GROUP BY ALL), n AS (SELECT sum(c) AS n FROM c),
pa AS (SELECT a, sum(c) AS ca FROM c GROUP BY a), pb AS (SELECT b, sum(c) AS cb FROM c GROUP BY b),
mi AS (SELECT sum(c/n*ln(c*n/(ca*cb))) AS mi FROM c JOIN pa USING (a) JOIN pb USING (b), n), ha AS (SELECT -sum(ca/n*ln(ca/n)) AS ha FROM pa, n), hb AS (SELECT -sum(cb/n*ln(cb/n)) AS hb FROM pb, n)
SELECT round(mi, 6) AS mi, round(ha, 6) AS ha, round(hb, 6) AS hb, round(mi/((ha+hb)/2), 6) AS nmi FROM mi, ha, hb""")
def nmi_two_labelings(spark, sf):
    k = stats.nmi(S.cohort(spark, sf), "institution", "source")
    return k.select(*[r6(F.col(c)).alias(c) for c in k.columns])


cte("t_pedges", "SELECT DISTINCT 'c' || CAST(subject AS VARCHAR) AS src, 's' || CAST(source AS VARCHAR) AS dst FROM t_cohort")


def pair_graph(spark, sf):
    """Undirected subject-source graph of the cohort (roles keep separate ids)."""
    return S.cohort(spark, sf).select(F.concat(F.lit("c"), "subject").alias("src"), F.concat(F.lit("s"), "source").alias("dst")).distinct()


def institution_labels(spark, sf):
    n = S.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    c = S.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("n_nationkey"))
    s = S.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("n_nationkey"))
    return c.unionByName(s).join(n, "n_nationkey").select("node", F.col("n_regionkey").alias("community"))


@query("partition_modularity", """
WITH l AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS node, n_regionkey AS community FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
e AS (SELECT a.community AS ca, b.community AS cb FROM t_pedges JOIN l a ON a.node = src JOIN l b ON b.node = dst), m AS (SELECT count(*)::DOUBLE AS m, sum((ca=cb)::INT)::DOUBLE AS i FROM e),
d AS (SELECT c, count(*)::DOUBLE AS deg FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) x GROUP BY c)
SELECT round(any_value(i)/any_value(m) - sum(deg*deg)/(4*any_value(m)*any_value(m)), 6) AS q, count(*) AS n_communities FROM d, m""")
def partition_modularity(spark, sf):
    """Modularity of the partition by region."""
    return stats.modularity(pair_graph(spark, sf), institution_labels(spark, sf)).select(r6(F.col("q")).alias("q"), "n_communities")


@query("fragmentation_stats", """
WITH n AS (SELECT src AS node, dst AS comp FROM t_pedges UNION SELECT dst, dst FROM t_pedges)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM t_pedges) AS edges, count(*) AS components, max(sz) AS lcc_size, round(max(sz)::DOUBLE / sum(sz), 6) AS lcc_coverage,
 (SELECT count(*) FROM t_pedges) < (SELECT count(*) FROM n) AS is_forest FROM (SELECT comp, count(*) AS sz FROM n GROUP BY comp) x""")
def fragmentation_stats(spark, sf):
    """Each cohort row has one source, so a component is a source with its subjects."""
    from cohortry.operators.graph import fragmentation
    e = pair_graph(spark, sf)
    labels = e.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(e.select("dst", "dst")).distinct()
    return fragmentation(e, labels)


@query("geo_influence", """
WITH p AS (SELECT pid, nat, score FROM (SELECT 'c' || CAST(subject AS VARCHAR) AS pid, c_nationkey AS nat, early_prod::DOUBLE AS score FROM t_cohort JOIN customer ON c_custkey = subject
 UNION ALL SELECT 's' || CAST(source AS VARCHAR), s_nationkey, min(source_prod)::DOUBLE FROM t_cohort JOIN supplier ON s_suppkey = source GROUP BY source, s_nationkey) x)
SELECT n_name AS country, round(sum(score), 5) AS total, round(avg(score), 5) AS mean, count(*) AS n FROM p JOIN nation ON n_nationkey = nat GROUP BY n_name""")
def geo_influence(spark, sf):
    """Score totals by country over everyone in either role, one place per person."""
    c = S.cohort(spark, sf)
    cust = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("n_nationkey"))
    supp = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("n_nationkey"))
    a = c.select("subject", F.col("early_prod").cast("double").alias("score")).join(cust, "subject").select("n_nationkey", "score")
    b = c.groupBy("source").agg(F.min("source_prod").cast("double").alias("score")).join(supp, "source").select("n_nationkey", "score")
    return (a.unionByName(b).join(S.table(spark, sf, "nation"), "n_nationkey").groupBy(F.col("n_name").alias("country"))
            .agg(F.round(F.sum("score"), 5).alias("total"), F.round(F.avg("score"), 5).alias("mean"), n_rows()))
