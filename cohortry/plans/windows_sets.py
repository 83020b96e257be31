"""Window functions, sorts, limits and set operations."""

from pyspark.sql import Window as W, functions as F

from cohortry.functions.columns import r6
from cohortry.operators import impact, stats
from cohortry.operators.ordering import cumulate, first_by
from cohortry.plans import stages as S
from cohortry.plans.aggregates import n_rows, terciles
from cohortry.plans.ingest import PAIR_RUNS, diff_counts, pair_run
from cohortry.plans.registry import query


@query("rank_pct_within", """
SELECT p_brand, p_retailprice, round((coalesce(sum(n) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1)/2.0::DOUBLE) / sum(n) OVER (PARTITION BY p_brand), 6) AS pct
FROM (SELECT p_brand, p_retailprice, count(*) AS n FROM part GROUP BY ALL) y""")
def rank_pct_within(spark, sf):
    p = S.table(spark, sf, "part").select("p_brand", "p_retailprice")
    return impact.percentile_dim(p, "p_brand", "p_retailprice").withColumn("pct", r6(F.col("pct")))


@query("first_wins_dedupe", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1""")
def first_wins_dedupe(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return first_by(S.table(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in order], order)


@query("running_counts_desc", """
SELECT field, model, seed, score, (sum(tp) OVER w)::BIGINT AS tp, (sum(n - tp) OVER w)::BIGINT AS fp
FROM (SELECT field, model, seed, score, sum(y)::BIGINT AS tp, count(*) AS n FROM t_scores WHERE split = 'test' GROUP BY ALL) x
WINDOW w AS (PARTITION BY field, model, seed ORDER BY score DESC)""")
def running_counts_desc(spark, sf):
    s = S.scores(spark, sf).where("split = 'test'")
    c = cumulate(s, ["field", "model", "seed"], "score", {"tp": F.col("y"), "fp": 1 - F.col("y")})
    return c.select("field", "model", "seed", "score", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"))


def frame(spark, sf, upto):
    folded = S.cohort(spark, sf).groupBy("source", "t0").agg(n_rows(), F.sum("y").alias("y"))
    w = W.partitionBy("source").orderBy("t0").rangeBetween(W.unboundedPreceding, upto)
    return folded.select("source", "t0", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("y").over(w), F.lit(0)).alias("positives"))


FRAME = """SELECT DISTINCT source, t0, coalesce(count(*) OVER w, 0) AS n, coalesce(sum(y) OVER w, 0)::BIGINT AS positives FROM t_cohort WINDOW w AS (PARTITION BY source ORDER BY t0 RANGE BETWEEN UNBOUNDED PRECEDING AND {f})"""


@query("prior_range_frame", FRAME.format(f="CURRENT ROW"))
def prior_range_frame(spark, sf):
    return frame(spark, sf, 0)


@query("closed_range_frame", FRAME.format(f="10 PRECEDING"))
def closed_range_frame(spark, sf):
    return frame(spark, sf, -10)


@query("tercile_label", "SELECT subject, stratum FROM t_terc")
def tercile_label(spark, sf):
    return terciles(S.cohort(spark, sf), ["field"], "early_prod").select("subject", "stratum")


@query("quantile_split", """
SELECT subject, CASE WHEN early_overlap <= q THEN 'low' ELSE 'high' END AS half FROM t_cohort, (SELECT quantile_cont(early_overlap, 0.5) AS q FROM t_cohort) m""")
def quantile_split(spark, sf):
    return stats.quantile_label(S.cohort(spark, sf), [], "early_overlap", [0.5], ["low", "high"], "half").select("subject", "half")


@query("topn_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topn_by_score(spark, sf):
    """A top-50 report: each task keeps its own 50 before they meet."""
    return S.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)


@query("topn_other_pool", """
WITH t AS (SELECT institution FROM t_cohort GROUP BY institution ORDER BY count(*) DESC, institution LIMIT 30)
SELECT CASE WHEN institution IN (SELECT institution FROM t) THEN institution ELSE 'OTHER' END AS pool, count(*) AS n, round(avg(y::DOUBLE), 6) AS base_rate FROM t_cohort GROUP BY ALL""")
def topn_other_pool(spark, sf):
    c = S.cohort(spark, sf).groupBy("institution").agg(n_rows(), F.sum("y").alias("pos"))
    r = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "institution"))  # one row per institution
    pooled = c.withColumn("pool", F.when(r <= 30, F.col("institution")).otherwise("OTHER"))
    return pooled.groupBy("pool").agg(F.sum("n").alias("n"), r6(F.sum("pos") / F.sum("n")).alias("base_rate"))


@query("frequent_pool", """
SELECT CASE WHEN n >= 30 THEN institution ELSE '(other)' END AS pool, sum(n)::BIGINT AS n FROM (SELECT institution, count(*) AS n FROM t_cohort GROUP BY institution) x GROUP BY ALL""")
def frequent_pool(spark, sf):
    c = S.cohort(spark, sf).groupBy("institution").agg(n_rows())
    return c.groupBy(F.when(F.col("n") >= 30, F.col("institution")).otherwise("(other)").alias("pool")).agg(F.sum("n").alias("n"))


@query("degree_threshold_pick", """
WITH d AS (SELECT deg, count(*) AS n FROM (SELECT node, count(*) AS deg FROM (SELECT subject AS node FROM t_edges UNION ALL SELECT -1 - source FROM t_edges) x GROUP BY node) y GROUP BY deg),
c AS (SELECT deg, sum(n) OVER (ORDER BY deg DESC) AS at_least FROM d)
SELECT coalesce(max(deg) FILTER (WHERE at_least > 1000), 0) + 1 AS threshold, coalesce(max(at_least) FILTER (WHERE at_least <= 1000), 0)::BIGINT AS n_nodes,
  coalesce(max(at_least) FILTER (WHERE at_least <= 1000), 0) >= 560 AS on_target FROM c""")
def degree_threshold_pick(spark, sf):
    """Smallest degree that leaves at most 1000 nodes, and whether at least 560 remain."""
    e = S.edges(spark, sf)
    deg = e.select(F.col("subject").alias("node")).union(e.select(-1 - F.col("source"))).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    c = cumulate(deg, [], "deg", {"n": F.lit(1)})
    at = F.coalesce(F.max(F.when(F.col("cum_n") <= 1000, F.col("cum_n"))), F.lit(0))
    return c.agg((F.coalesce(F.max(F.when(F.col("cum_n") > 1000, F.col("deg"))), F.lit(0)) + 1).alias("threshold"), at.alias("n_nodes"), (at >= 560).alias("on_target"))


@query("canonical_sort", """
WITH e AS (SELECT DISTINCT least(subject, source) AS a, greatest(subject, source) AS b FROM t_edges WHERE subject <> source), n AS (SELECT a AS node FROM e UNION SELECT b FROM e)
SELECT node, row_number() OVER (ORDER BY node) AS place, (SELECT count(*) FROM e WHERE a = node) AS forward_degree FROM n""")
def canonical_sort(spark, sf):
    """Node places in id order and the number of canonical (a < b) edges each node owns."""
    e = S.edges(spark, sf).where("subject <> source").select(F.least("subject", "source").alias("a"), F.greatest("subject", "source").alias("b")).distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    place = cumulate(nodes, [], "node", {"n": F.lit(1)}, descending=False).select("node", F.col("cum_n").alias("place"))
    fwd = e.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("forward_degree"))
    return place.join(fwd, "node", "left").withColumn("forward_degree", F.coalesce("forward_degree", F.lit(0)))


@query("role_union", "SELECT subject AS id FROM t_edges UNION SELECT source FROM t_edges")
def role_union(spark, sf):
    e = S.edges(spark, sf)
    return e.select(F.col("subject").alias("id")).union(e.select("source")).distinct()


@query("vocab_union", "SELECT tag, count(*) AS n FROM (SELECT DISTINCT field, tag FROM (SELECT field, unnest(early_tags) AS tag FROM t_cohort UNION ALL SELECT field, unnest(source_tags) FROM t_cohort) x) y GROUP BY tag")
def vocab_union(spark, sf):
    return S.cohort(spark, sf).select("field", F.explode(F.array_union("early_tags", "source_tags")).alias("tag")).distinct().groupBy("tag").agg(n_rows())


@query("set_minus_counts", PAIR_RUNS + "SELECT (SELECT count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM n) a) AS ref_only, (SELECT count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM r) b) AS new_only")
def set_minus_counts(spark, sf):
    return diff_counts(pair_run(spark, sf, "F"), pair_run(spark, sf, "O"), ["subject", "source"]).select("ref_only", "new_only")


@query("set_intersection", PAIR_RUNS + "SELECT * FROM r INTERSECT SELECT * FROM n")
def set_intersection(spark, sf):
    return pair_run(spark, sf, "F").intersect(pair_run(spark, sf, "O"))


@query("set_equal_rows", "SELECT field, count(*) FILTER (WHERE early_tags = late_tags) AS equal_sets, count(*) FILTER (WHERE early_tags <> late_tags) AS other FROM t_cohort GROUP BY field")
def set_equal_rows(spark, sf):
    same = F.sort_array("early_tags") == F.sort_array("late_tags")
    return S.cohort(spark, sf).groupBy("field").agg(F.count_if(same).alias("equal_sets"), F.count_if(~same).alias("other"))


@query("distinct_pairs", "SELECT DISTINCT source, tag FROM (SELECT source, unnest(source_tags) AS tag FROM t_cohort) x")
def distinct_pairs(spark, sf):
    return S.cohort(spark, sf).select("source", F.explode("source_tags").alias("tag")).dropDuplicates()
