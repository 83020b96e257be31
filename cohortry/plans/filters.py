"""Projections, filters, predicates."""

from pyspark.sql import functions as F

from cohortry.functions.columns import r6
from cohortry.operators import cohort as C, filters as P, profiles
from cohortry.operators.ordering import top_k
from cohortry.plans import stages as S
from cohortry.plans.registry import cte, query
from cohortry.specs import FeatureSpec


@query("id_tail", "SELECT page_id, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) AS tail FROM pages")
def id_tail(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", P.id_tail(F.col("url")).alias("tail"))


@query("edge_select_both_ends", """
SELECT e.subject, e.source FROM t_edges e JOIN customer ON c_custkey = e.subject JOIN nation cn ON cn.n_nationkey = c_nationkey
JOIN supplier ON s_suppkey = e.source JOIN nation sn ON sn.n_nationkey = s_nationkey
WHERE e.subject <> 0 AND e.source <> 0 AND cn.n_regionkey = 1 AND sn.n_regionkey = 1""")
def edge_select_both_ends(spark, sf):
    """Edges inside one region: both ends list it among their categories. Key 0 means absent."""
    n = S.table(spark, sf, "nation").select("n_nationkey", F.concat_ws(", ", "n_name", F.concat(F.lit("R"), F.col("n_regionkey"))).alias("categories"))
    subj = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    src = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    e = S.edges(spark, sf).select("subject", "source", F.lit(1).alias("relation"))
    # the two roles keep their own id spaces here: customer ids and supplier ids overlap
    tagged = e.withColumn("subject", F.concat(F.lit("c"), "subject")).withColumn("source", F.concat(F.lit("s"), "source"))
    persons = (subj.select(F.concat(F.lit("c"), "pid").alias("pid"), "categories")
               .unionByName(src.select(F.concat(F.lit("s"), "pid").alias("pid"), "categories")))
    kept = P.both_ends(tagged.where(~F.col("subject").isin("c0") & ~F.col("source").isin("s0")), persons, "R1")
    return kept.select(F.substring("subject", 2, 20).cast("bigint").alias("subject"), F.substring("source", 2, 20).cast("bigint").alias("source"))


@query("first_token", "SELECT p_partkey, string_split(trim(p_name), ' ')[1] AS token FROM part")
def first_token(spark, sf):
    listing = F.concat(F.lit(" , "), F.regexp_replace("p_name", " ", " ,"))
    return S.table(spark, sf, "part").select("p_partkey", P.first_token(listing).alias("token"))


@query("tag_collapse", "SELECT event_id, tag_pos, tag FROM t_stags")
def tag_collapse(spark, sf):
    rows = profiles.collapse_tags(S.lines(spark, sf), ["subject", "event_id", "period"], "tag", "score",
                                  ["line", "part", "source"], S.SPEC.min_score, S.SPEC.tags_per_event)
    return rows.select("event_id", "tag_pos", "tag")


@query("work_cap", """
SELECT source, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT source, event_id, row_number() OVER (PARTITION BY source ORDER BY event_date, event_id) AS rn
FROM (SELECT DISTINCT source, event_id, event_date FROM t_lines JOIN t_ev USING (event_id)) d) x WHERE rn <= 400""")
def work_cap(spark, sf):
    """Earliest 400 events per source by date."""
    ev = S.lines(spark, sf).select("source", "event_id").distinct().join(S.events(spark, sf).select("event_id", "event_date"), "event_id")
    return top_k(ev, ["source"], [F.col("event_date"), F.col("event_id")], 400).select("source", "event_id", "rn")


@query("capped_author_drop", """
SELECT subject, source, t0, y FROM t_cohort WHERE subject NOT IN (SELECT subject FROM t_ev GROUP BY subject HAVING count(*) >= 400)""")
def capped_author_drop(spark, sf):
    """Drop subjects whose history hit the cap of 400 events."""
    capped = S.events(spark, sf).groupBy("subject").count().where(F.col("count") >= 400).select("subject")
    return S.cohort(spark, sf).join(capped, "subject", "left_anti").select("subject", "source", "t0", "y")


@query("null_normalise", "SELECT o_orderkey, nullif(CASE WHEN o_orderstatus = 'P' THEN 'NULL' ELSE o_orderstatus END, 'NULL') AS status FROM orders")
def null_normalise(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "P", "NULL").otherwise(F.col("o_orderstatus"))
    return S.table(spark, sf, "orders").select("o_orderkey", P.nullify(raw).alias("status"))


@query("value_standardise", """
SELECT c_custkey, CASE n_name WHEN 'NATION_1' THEN 'America One' WHEN 'NATION_2' THEN 'Asia Two' ELSE n_name END AS country
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def value_standardise(spark, sf):
    synonyms = spark.createDataFrame([("NATION_1", "America One"), ("NATION_2", "Asia Two")], "spelling string, standard string")
    c = S.table(spark, sf, "customer").join(S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.standardise(c.select("c_custkey", "n_name"), "n_name", synonyms, "country").select("c_custkey", "country")


@query("window_predicate", """
SELECT count(*) FILTER (WHERE period BETWEEN 7990 AND 7995) AS closed, count(*) FILTER (WHERE period <= 7995) AS open_left,
       count(*) FILTER (WHERE period >= 7990) AS open_right, count(*) AS all_rows FROM t_ev""")
def window_predicate(spark, sf):
    p = F.col("period")
    return S.events(spark, sf).agg(
        F.count_if(P.in_window(p, 7990, 7995)).alias("closed"), F.count_if(P.in_window(p, None, 7995)).alias("open_left"),
        F.count_if(P.in_window(p, 7990, None)).alias("open_right"), F.count_if(P.in_window(p, None, None)).alias("all_rows"))


@query("funnel_cascade", "SELECT field, coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM t_funnel GROUP BY ALL")
def funnel_cascade(spark, sf):
    return S.funnel(spark, sf).groupBy("field", F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("empty_profile_drop", """
SELECT count(*) FILTER (WHERE len(early_tags) > 0) AS kept, count(*) FILTER (WHERE len(early_tags) = 0) AS dropped FROM t_subj""")
def empty_profile_drop(spark, sf):
    n = F.size("early_tags")
    return S.subjects(spark, sf).agg(F.count_if(n > 0).alias("kept"), F.count_if(n == 0).alias("dropped"))


@query("feature_project", """
SELECT subject, early_prod::DOUBLE AS early_prod, early_breadth::DOUBLE AS early_breadth, source_prod::DOUBLE AS source_prod,
       source_breadth::DOUBLE AS source_breadth, source_age::DOUBLE AS source_age, early_overlap, t0::DOUBLE AS t0, interacted::INTEGER::DOUBLE AS interacted
FROM t_cohort""")
def feature_project(spark, sf):
    return P.project_features(S.cohort(spark, sf), ["subject"], FeatureSpec())


ALLOWED = {"field", "subject", "source", "institution", "region", "t0", "early_prod", "early_breadth", "source_prod", "source_breadth",
           "source_age", "early_overlap", "interacted", "interaction_n", "y", "late_overlap", "late_prod", "early_tags", "source_tags", "late_tags"}
BANNED = {"st_h_index", "adv_h_index", "career_len", "co_authored"}


@query("leakage_guard", """
WITH c AS (SELECT count(*) FILTER (WHERE t0 + 15 > 8007) AS right_censored, count(*) FILTER (WHERE t0 < 7800) AS implausible_t0,
 count(*) FILTER (WHERE (late_overlap > 0.2::DOUBLE)::INTEGER <> y) AS label_mismatch, count(*) - count(DISTINCT subject) AS duplicate_subjects,
 count(*) FILTER (WHERE interaction_n < 0) AS missing_interactions, 0::BIGINT AS banned_columns, 0::BIGINT AS unclassified_columns FROM t_cohort)
SELECT invariant, violations FROM (UNPIVOT c ON COLUMNS(*) INTO NAME invariant VALUE violations)""")
def leakage_guard(spark, sf):
    return C.guard_violations(S.cohort(spark, sf), S.SPEC, ALLOWED, BANNED)


@query("min_events_filter", """
SELECT arm, count(DISTINCT subject) AS subjects, count(*) AS edges FROM t_funnel, (VALUES (2), (3), (5)) a(arm)
WHERE (drop_reason IS NULL OR drop_reason = 'sparse_windows')
  AND early_prod >= arm AND late_prod >= arm AND coalesce(source_prod, 0) >= 3 GROUP BY arm""")
def min_events_filter(spark, sf):
    """Cohort size when both windows must hold at least 2, 3 or 5 events."""
    f = S.funnel(spark, sf).where(F.col("drop_reason").isNull() | (F.col("drop_reason") == "sparse_windows"))
    arms = f.withColumn("arm", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))))
    ok = (F.col("early_prod") >= F.col("arm")) & (F.col("late_prod") >= F.col("arm")) & (F.coalesce("source_prod", F.lit(0)) >= 3)
    return arms.where(ok).groupBy("arm").agg(F.count_distinct("subject").alias("subjects"), F.count(F.lit(1)).alias("edges"))


@query("cohort_floor_filter", "SELECT field, count(*) AS n, round(avg(y::DOUBLE), 6) AS base_rate FROM t_cohort WHERE t0 >= 7983 GROUP BY field")
def cohort_floor_filter(spark, sf):
    return S.cohort(spark, sf).where(P.in_window(F.col("t0"), 7983, None)).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("base_rate"))


def size_levels(spark, sf):
    """Level of a coarse tag: its mean part size, cut to an integer; tags without small parts stay unknown."""
    p = S.table(spark, sf, "part")
    return (p.groupBy(F.concat_ws("/", "p_type", (F.col("p_size") % 5).cast("string")).alias("tag"))
            .agg((F.count(F.lit(1)) % 3).cast("int").alias("level")).where(F.col("level") > 0))


cte("t_szlev", """SELECT tag, level FROM (SELECT p_type || '/' || CAST(p_size % 5 AS VARCHAR) AS tag, CAST(count(*) % 3 AS INTEGER) AS level
FROM part GROUP BY ALL) x WHERE level > 0""")


@query("tag_level_restrict", """
SELECT s.event_id, s.tag, coalesce(level, -1) AS level FROM t_stags s LEFT JOIN t_szlev l ON s.tag = l.tag WHERE coalesce(level, -1) >= 1""")
def tag_level_restrict(spark, sf):
    """Keep tags at level >= 1; an unknown tag has level -1."""
    t = S.subject_tags(spark, sf).join(size_levels(spark, sf), "tag", "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    return t.where(F.col("level") >= 1).select("event_id", "tag", "level")


@query("tag_vocab_eligible", """
SELECT s.subject, s.event_id, s.tag FROM t_stags s JOIN t_bounds b USING (subject)
JOIN (SELECT tag, min(period) AS seen FROM t_lines GROUP BY tag) f USING (tag) WHERE seen <= t0 + 5""")
def tag_vocab_eligible(spark, sf):
    """Tags already part of the vocabulary (first use anywhere) when the row is frozen."""
    earliest = S.lines(spark, sf).groupBy("tag").agg(F.min("period").alias("seen"))
    return (S.subject_tags(spark, sf).join(S.subjects(spark, sf).select("subject", "t0"), "subject").join(earliest, "tag")
            .where(F.col("seen") <= F.col("t0") + S.SPEC.windows.early).select("subject", "event_id", "tag"))


@query("level_min_on_collision", "SELECT lower(p_name) AS name, min(p_size) AS level FROM part GROUP BY ALL")
def level_min_on_collision(spark, sf):
    return S.table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_size").alias("level"))


@query("union_window_filter", """
WITH w AS (SELECT source, min(t0) AS lo, max(t0) + 5 AS hi FROM t_cohort GROUP BY source)
SELECT c.subject, c.source, coalesce(count(s.period), 0) AS kept_periods, CAST(coalesce(sum(s.n_events), 0) AS BIGINT) AS kept_events
FROM t_cohort c LEFT JOIN (SELECT t.* FROM t_sact t JOIN w ON t.source = w.source AND t.period BETWEEN w.lo AND w.hi) s
  ON s.source = c.source AND s.period BETWEEN c.t0 AND c.t0 + 5 GROUP BY ALL""")
def union_window_filter(spark, sf):
    """A source keeps the union of its cohorts' windows; each focal row filters again to its own."""
    c = S.cohort(spark, sf).select("subject", "source", "t0")
    union = c.groupBy("source").agg(F.min("t0").alias("lo"), (F.max("t0") + 5).alias("hi"))
    kept = S.source_activity(spark, sf).join(union, "source").where(F.col("period").between(F.col("lo"), F.col("hi")))
    cuts = c.select("source", "t0").distinct()
    per_cut = (cuts.join(kept, "source").where(F.col("period").between(F.col("t0"), F.col("t0") + 5))
               .groupBy("source", "t0").agg(F.count(F.lit(1)).alias("kept_periods"), F.sum("n_events").alias("kept_events")))
    z = F.lit(0).cast("bigint")
    return c.join(per_cut, ["source", "t0"], "left").select(
        "subject", "source", F.coalesce("kept_periods", z).alias("kept_periods"), F.coalesce("kept_events", z).alias("kept_events"))
