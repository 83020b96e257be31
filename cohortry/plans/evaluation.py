"""Metrics, paired tests, intervals, gates and certificates on the score table."""

from pyspark.sql import Window as W, functions as F

from cohortry.functions.columns import jaccard, r6
from cohortry.operators import draws as D, inference as I, metrics as M, profiles, stats
from cohortry.operators.ordering import quantiles
from cohortry.plans import draws as PD, stages as S
from cohortry.plans.aggregates import THETA_SQL, n_rows, theta_array
from cohortry.plans.joins import jac
from cohortry.plans.ingest import scratch
from cohortry.plans.registry import cte, query

# ---- SQL twins -------------------------------------------------------------------------------

SCRAMBLES, SEED_DRAWS = 30, 2000


def ap_sql(src, keys, y="y", score="score", where="TRUE", w="1"):
    k = ", ".join(keys)
    p = f"PARTITION BY {k}" if keys else ""
    kc = f"{k}, " if keys else ""
    g = f"GROUP BY {k}" if keys else ""
    return f"""SELECT {kc}coalesce(sum(CASE WHEN tp > 0 THEN pos::DOUBLE / tp * (cp::DOUBLE / cn) END), 0) AS ap, max(tp)::BIGINT AS positives, max(tn)::BIGINT AS rows_n FROM (
 SELECT {kc}pos, sum(pos) OVER ({p} ORDER BY {score} DESC) AS cp, sum(n) OVER ({p} ORDER BY {score} DESC) AS cn, sum(pos) OVER ({p}) AS tp, sum(n) OVER ({p}) AS tn FROM (
  SELECT {kc}{score}, sum({y} * {w})::BIGINT AS pos, sum({w})::BIGINT AS n FROM {src} WHERE {where} GROUP BY {kc}{score}) a) b {g}"""


def auc_sql(src, keys, y="y", score="score", where="TRUE"):
    k = ", ".join(keys)
    p = f"PARTITION BY {k}"
    return f"""SELECT {k}, sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(max(tp)::DOUBLE * (max(tn) - max(tp)), 0) AS auc, max(tn)::BIGINT AS rows_n FROM (
 SELECT {k}, pos, n - pos AS neg, coalesce(sum(n - pos) OVER ({p} ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER ({p}) AS tp, sum(n) OVER ({p}) AS tn FROM (
  SELECT {k}, {score}, sum({y})::BIGINT AS pos, count(*) AS n FROM {src} WHERE {where} GROUP BY {k}, {score}) a) b GROUP BY {k}"""


KEYS = ["field", "model", "seed"]
TEST = "split = 'test'"
cte("t_ap", f"SELECT field, model, seed, round(ap, 5) AS value FROM ({ap_sql('t_scores', KEYS, where=TEST)}) x")
PAIRS = [("overlap", "reach"), ("overlap", "volume"), ("reach", "volume")]
PAIR_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") p(a, b)"


def wil_sql(src, keys):
    k = ", ".join(keys)
    eq = " AND ".join(f"x.{c} = y.{c}" for c in keys)
    return f"""
WITH z AS (SELECT {k}, seed, d, rank() OVER (PARTITION BY {k} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {k}, abs(d)) - 1) / 2.0::DOUBLE AS r,
   row_number() OVER (PARTITION BY {k} ORDER BY abs(d), seed) - 1 AS i FROM {src} WHERE d <> 0),
wp AS (SELECT {k}, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS m FROM z GROUP BY {k}),
s AS (SELECT {k}, mask, sum(CASE WHEN (mask >> i::BIGINT) & 1 = 1 THEN r ELSE 0 END) AS s FROM z, range(1024) q(mask) GROUP BY {k}, mask),
pv AS (SELECT {', '.join('x.' + c for c in keys)}, least(1.0::DOUBLE, 2 * least(count(*) FILTER (WHERE s <= w_plus), count(*) FILTER (WHERE s >= w_plus))::DOUBLE / count(*)) AS p FROM s x JOIN wp y ON {eq} WHERE mask < (1::BIGINT << m) GROUP BY {', '.join('x.' + c for c in keys)}),
b AS (SELECT {k}, avg(va) AS mean_a, avg(vb) AS mean_b, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff, count(*) AS n, count(*) FILTER (WHERE d > 0) AS n_pos, count(*) FILTER (WHERE d < 0) AS n_neg, var_pop(vb) AS var_b FROM {src} GROUP BY {k})
SELECT b.*, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(p, 1) AS p FROM b LEFT JOIN wp USING ({k}) LEFT JOIN pv USING ({k})"""


def bh_sql(src, fam, order):
    f, o = ", ".join(fam), ", ".join(order)
    od = ", ".join(f"{c} DESC" for c in order)
    return f"""SELECT *, least(1.0::DOUBLE, min(raw) OVER (PARTITION BY {f} ORDER BY p DESC, {od} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adj
FROM (SELECT *, p * count(*) OVER (PARTITION BY {f}) / row_number() OVER (PARTITION BY {f} ORDER BY p, {o}) AS raw FROM {src}) x"""


cte("t_diff", f"SELECT x.field, p.a, p.b, x.seed, x.value AS va, y.value AS vb, round(x.value - y.value, 6) AS d FROM {PAIR_SQL} JOIN t_ap x ON x.model = p.a JOIN t_ap y ON y.model = p.b AND y.field = x.field AND y.seed = x.seed")
cte("t_wil", wil_sql("t_diff", ["field", "a", "b"]))
cte("t_bh", bh_sql("t_wil", ["field"], ["a", "b"]))
cte("t_bap", f"""SELECT field, model, seed, draw, ap FROM ({ap_sql('(SELECT s.field, s.model, s.seed, draw, y, score, weight FROM t_scores s JOIN t_boot b ON b.field = s.field AND b.subject = s.subject) q', ['field', 'model', 'seed', 'draw'], w='weight')}) x
 WHERE positives > 0 AND positives < rows_n""")
cte("t_bdiff", f"SELECT x.field, p.a, p.b, x.seed, x.draw, x.ap - y.ap AS d FROM {PAIR_SQL} JOIN t_bap x ON x.model = p.a JOIN t_bap y ON y.model = p.b AND y.field = x.field AND y.seed = x.seed AND y.draw = x.draw")
cte("t_bpool", "SELECT field, a, b, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, count(*) AS draws FROM (SELECT field, a, b, draw, round(avg(d), 9) AS d FROM t_bdiff GROUP BY ALL) x GROUP BY ALL")

# ---- Spark -----------------------------------------------------------------------------------


def test_scores(spark, sf):
    return S.scores(spark, sf).where("split = 'test'")


def aps(spark, sf):
    """AP per (field, model, seed) on the test rows, as stored by a run (5 places)."""
    return S.stage(spark, sf, "aps", lambda: M.average_precision(test_scores(spark, sf), KEYS).select(*KEYS, F.round("ap", 5).alias("value")))


def diffs(spark, sf):
    return I.paired_differences(aps(spark, sf), ["field"], "model", PAIRS)


def tests(spark, sf):
    return S.stage(spark, sf, "tests", lambda: I.bh(I.wilcoxon(diffs(spark, sf), ["field", "a", "b"]), ["field"], ["a", "b"]))


def boot_aps(spark, sf):
    """AP of every (field, model, seed) under the shared resamples: all draws in one pass over the ranking."""
    def build():
        a = M.resampled_precision(test_scores(spark, sf), KEYS, "subject", PD.DRAWS, share=["field"])
        return a.where((F.col("positives") > 0) & (F.col("positives") < F.col("rows"))).select(*KEYS, "draw", "ap")
    return S.stage(spark, sf, "boot_aps", build)


def interval(draws, keys, value, *more):
    """Percentile interval over the draws of each key: as many values as there are draws."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(q.alias("q"), *more).withColumns({"lo": F.col("q")[0], "hi": F.col("q")[1]}).drop("q")


def pooled(spark, sf):
    """Interval of the seed-mean difference over the shared draws."""
    def build():
        b = boot_aps(spark, sf).withColumnRenamed("ap", "value")
        d = I.paired_differences(b.select("field", "model", "seed", "draw", "value"), ["field", "draw"], "model", PAIRS)
        raw = d.groupBy("field", "a", "b", "draw").agg(F.round(F.avg(F.col("va") - F.col("vb")), 9).alias("d"))
        return interval(raw, ["field", "a", "b"], "d", F.count(F.lit(1)).alias("draws"))
    return S.stage(spark, sf, "pooled", build)


def rounded(df, keep, values):
    return df.select(*keep, *[r6(F.col(c)).alias(c) for c in values])


@query("average_precision", f"SELECT field, model, seed, round(ap, 6) AS ap FROM ({ap_sql('t_scores', KEYS, where=TEST)}) x")
def average_precision(spark, sf):
    return M.average_precision(test_scores(spark, sf), KEYS).select(*KEYS, r6(F.col("ap")).alias("ap"))


@query("auc_roc", f"SELECT field, model, seed, round(auc, 6) AS auc FROM ({auc_sql('t_scores', KEYS, where=TEST)}) x")
def auc_roc(spark, sf):
    return rounded(M.auc_roc(test_scores(spark, sf), KEYS), KEYS, ["auc"])


@query("average_precision_labels", f"SELECT lang, round(ap, 6) AS ap FROM ({ap_sql('(SELECT lang, quality AS y, length(text)::DOUBLE AS score FROM labels JOIN documents USING (doc_id)) q', ['lang'])}) x")
def average_precision_labels(spark, sf):
    """Document quality ranked by text length, per language."""
    d = S.table(spark, sf, "documents").select("doc_id", "lang", F.length("text").cast("double").alias("score"))
    s = S.table(spark, sf, "labels").join(d, "doc_id").select("lang", F.col("quality").alias("y"), "score")
    return rounded(M.average_precision(s, ["lang"]), ["lang"], ["ap"])


@query("f1_best_threshold", """
WITH c AS (SELECT field, model, seed, score, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY field, model, seed) AS tp FROM (
  SELECT field, model, seed, score, sum(y)::BIGINT AS pos, count(*) AS n FROM t_scores WHERE split = 'val' GROUP BY ALL) a WINDOW w AS (PARTITION BY field, model, seed ORDER BY score DESC)),
t AS (SELECT field, model, seed, score AS threshold FROM c QUALIFY row_number() OVER (PARTITION BY field, model, seed ORDER BY 2.0::DOUBLE*cp/(cn+tp) DESC, score) = 1)
SELECT s.field, s.model, s.seed, any_value(threshold) AS threshold, round(coalesce(2.0::DOUBLE*count(*) FILTER (WHERE score >= threshold AND y = 1) / nullif(2.0::DOUBLE*count(*) FILTER (WHERE score >= threshold AND y = 1) + count(*) FILTER (WHERE score >= threshold AND y = 0) + count(*) FILTER (WHERE score < threshold AND y = 1), 0), 0), 6) AS f1
FROM t_scores s JOIN t USING (field, model, seed) WHERE split = 'test' GROUP BY ALL""")
def f1_best_threshold(spark, sf):
    """Threshold chosen on validation rows only, F1 on test rows."""
    t = M.best_f1_threshold(S.scores(spark, sf).where("split = 'val'"), KEYS).select(*KEYS, "threshold")
    s = test_scores(spark, sf).join(t, KEYS)
    return M.f1_at(s, [*KEYS, "threshold"], F.col("threshold")).select(*KEYS, "threshold", r6(F.col("f1")).alias("f1"))


MASKS = "SELECT subject, unnest(CASE WHEN early_prod > 3 THEN ['all', 'active'] ELSE ['all', 'quiet'] END) AS mask FROM t_cohort"


@query("eval_masks", f"SELECT mask, field, model, seed, round(ap, 6) AS ap FROM ({ap_sql(f'(SELECT mask, field, model, seed, y, score FROM t_scores JOIN ({MASKS}) m USING (subject) WHERE {TEST}) q', ['mask', 'field', 'model', 'seed'])}) x")
def eval_masks(spark, sf):
    """One fit, many row masks: the mask is a column."""
    m = S.cohort(spark, sf).select("subject", F.explode(F.when(F.col("early_prod") > 3, F.array(F.lit("all"), F.lit("active"))).otherwise(F.array(F.lit("all"), F.lit("quiet")))).alias("mask"))
    k = ["mask", *KEYS]
    return rounded(M.average_precision(test_scores(spark, sf).join(m, "subject"), k), k, ["ap"])


@query("signed_rank_parts", "SELECT field, a, b, n_pos, n_neg, w_plus, w_minus FROM t_wil")
def signed_rank_parts(spark, sf):
    return I.wilcoxon(diffs(spark, sf), ["field", "a", "b"]).select("field", "a", "b", "n_pos", "n_neg", "w_plus", "w_minus")


@query("wilcoxon_paired", "SELECT field, a, b, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(p, 6) AS p FROM t_wil")
def wilcoxon_paired(spark, sf):
    return rounded(tests(spark, sf), ["field", "a", "b"], ["mean_diff", "sd_diff", "p"])


@query("bh_adjust", "SELECT field, a, b, round(p, 6) AS p, round(p_adj, 6) AS p_adj, p_adj <= 0.05::DOUBLE AS rejected FROM t_bh")
def bh_adjust(spark, sf):
    return rounded(tests(spark, sf), ["field", "a", "b", (F.col("p_adj") <= 0.05).alias("rejected")], ["p", "p_adj"])


@query("cohens_d_paired", "SELECT field, a, b, round(mean_diff / nullif(sd_diff, 0), 5) AS d FROM t_wil")
def cohens_d_paired(spark, sf):
    return tests(spark, sf).select("field", "a", "b", F.round(I.cohens_d(F.col("mean_diff"), F.col("sd_diff")), 5).alias("d"))


@query("bootstrap_ci", "SELECT field, model, seed, round(quantile_cont(ap, 0.025), 6) AS lo, round(quantile_cont(ap, 0.975), 6) AS hi FROM t_bap GROUP BY ALL")
def bootstrap_ci(spark, sf):
    return rounded(interval(boot_aps(spark, sf), KEYS, "ap"), KEYS, ["lo", "hi"])


@query("bootstrap_paired", "SELECT field, a, b, round(lo, 6) AS lo, round(hi, 6) AS hi, draws FROM t_bpool")
def bootstrap_paired(spark, sf):
    return rounded(pooled(spark, sf), ["field", "a", "b", "draws"], ["lo", "hi"])


def seedboot_sql(src, keys):
    k = ", ".join(keys)
    eq = " AND ".join(f"s.{c} = d.{c}" for c in keys)
    return f"""SELECT {k}, avg_d AS mean_diff, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg_d - 2.262::DOUBLE * sd / sqrt(n) AS t_lo, avg_d + 2.262::DOUBLE * sd / sqrt(n) AS t_hi FROM (
 SELECT {', '.join('s.' + c for c in keys)}, s.draw, round(avg(d.d), 9) AS m FROM (SELECT DISTINCT {k}, seed AS slot, draw, {PD.HINT.format(k="concat_ws('|', draw, 'seedboot', seed)")} % 10 AS seed FROM {src}, range({SEED_DRAWS}) r(draw)) s JOIN {src} d ON {eq} AND d.seed = s.seed GROUP BY ALL) x
 JOIN (SELECT {k}, avg(d) AS avg_d, stddev_samp(d) AS sd, count(*) AS n FROM {src} GROUP BY {k}) y USING ({k}) GROUP BY {k}, avg_d, sd, n"""


cte("t_sboot", seedboot_sql("t_diff", ["field", "a", "b"]))


@query("bootstrap_seed_level", "SELECT field, a, b, round(mean_diff, 6) AS mean_diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(t_lo, 6) AS t_lo, round(t_hi, 6) AS t_hi FROM t_sboot")
def bootstrap_seed_level(spark, sf):
    return rounded(I.seed_bootstrap(diffs(spark, sf), ["field", "a", "b"], SEED_DRAWS), ["field", "a", "b"], ["mean_diff", "lo", "hi", "t_lo", "t_hi"])


def scr_sql(cell):
    c = ", ".join(cell)
    on = " AND ".join(f"a.{x} = b.{x}" for x in ["seed", *cell])
    return f"""SELECT a.field, a.seed, a.early_overlap AS score, b.y FROM (SELECT s AS seed, *, row_number() OVER (PARTITION BY s, {c} ORDER BY md5(concat_ws('|', s, 'permute', 'to', subject)), subject) AS rn FROM t_split, range({SCRAMBLES}) r(s)) a
 JOIN (SELECT s AS seed, *, row_number() OVER (PARTITION BY s, {c} ORDER BY md5(concat_ws('|', s, 'permute', 'from', subject)), subject) AS rn FROM t_split, range({SCRAMBLES}) r(s)) b ON {on} AND a.rn = b.rn"""


cte("t_scr", f"SELECT 'global' AS variant, * FROM ({scr_sql(['field'])}) x UNION ALL SELECT 'cell', * FROM ({scr_sql(['field', 'split', 't0'])}) y")
cte("t_scrauc", auc_sql("t_scr", ["variant", "field", "seed"]))
cte("t_scrap", ap_sql("t_scr", ["variant", "field", "seed"]))


def scrambles(spark, sf):
    """Raw overlap against labels permuted over the field and inside (split, t0) cells, thirty seeds."""
    def build():
        c = S.split(spark, sf).select("field", "split", "t0", "subject", "y", F.col("early_overlap").alias("score"))
        a = D.permute_seeds(c, ["field"], "subject", "y", SCRAMBLES, "y_perm").withColumn("variant", F.lit("global"))
        b = D.permute_seeds(c, ["field", "split", "t0"], "subject", "y", SCRAMBLES, "y_perm").withColumn("variant", F.lit("cell"))
        cols = ["variant", "field", "seed", F.col("y_perm").alias("y"), "score"]
        return a.select(*cols).unionByName(b.select(*cols))
    return S.stage(spark, sf, "scrambles", build)


@query("ttest_one_sample", "SELECT variant, field, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS sd, round((avg(auc) - 0.5::DOUBLE) / (stddev_samp(auc) / sqrt(count(*))), 4) AS t FROM t_scrauc GROUP BY ALL")
def ttest_one_sample(spark, sf):
    a = M.auc_roc(scrambles(spark, sf), ["variant", "field", "seed"])
    m, s, n = F.avg("auc"), F.stddev_samp("auc"), F.count("auc")
    return a.groupBy("variant", "field").agg(r6(m).alias("mean"), r6(s).alias("sd"), F.round((m - 0.5) / (s / F.sqrt(n)), 4).alias("t"))


@query("three_gate_verdict", """
SELECT field, a, b, mean_a > mean_b AS gate_mean, p_adj < 0.05::DOUBLE AS gate_p, lo > 0 AS gate_ci, mean_a > mean_b AND p_adj < 0.05::DOUBLE AND lo > 0 AS exceeds FROM t_bh JOIN t_bpool USING (field, a, b)""")
def three_gate_verdict(spark, sf):
    j = tests(spark, sf).join(pooled(spark, sf), ["field", "a", "b"])
    g = I.gates(F.col("mean_a"), F.col("mean_b"), F.col("p_adj"), F.col("lo"))
    return j.select("field", "a", "b", *[c.alias(n) for n, c in g.items()])


@query("ceiling_variants", """
SELECT field, round(avg(greatest(v, r)), 6) AS mean_of_max, round(greatest(avg(v), avg(r)), 6) AS max_of_means, round(avg(r), 6) AS single FROM (
 SELECT field, seed, max(value) FILTER (WHERE model = 'volume') AS v, max(value) FILTER (WHERE model = 'reach') AS r FROM t_ap GROUP BY ALL) x GROUP BY field""")
def ceiling_variants(spark, sf):
    p = aps(spark, sf).groupBy("field", "seed").pivot("model", ["volume", "reach"]).agg(F.max("value"))
    return p.groupBy("field").agg(r6(F.avg(F.greatest("volume", "reach"))).alias("mean_of_max"), r6(F.greatest(F.avg("volume"), F.avg("reach"))).alias("max_of_means"), r6(F.avg("reach")).alias("single"))


cte("t_plap", ap_sql("(SELECT field, seed, y, eo AS score FROM t_placebo WHERE split = 'test') q", ["field", "seed"]))
cte("t_trueap", ap_sql("(SELECT field, y, early_overlap AS score FROM t_split WHERE split = 'test') q", ["field"]))
cte("t_branch", """
SELECT field, CASE WHEN mv >= mr THEN 'volume' ELSE 'reach' END AS best_model, greatest(mv, mr) AS best, m1, band, base, CASE WHEN mv >= mr THEN lv ELSE lr END AS lo, CASE WHEN mv >= mr THEN hv ELSE hr END AS hi FROM (
 SELECT field, avg(value) FILTER (WHERE model = 'volume') AS mv, avg(value) FILTER (WHERE model = 'reach') AS mr, avg(value) FILTER (WHERE model = 'overlap') AS m1 FROM t_ap GROUP BY field) a
 JOIN (SELECT field, avg(ap) AS band FROM t_plap GROUP BY field) b USING (field) JOIN (SELECT field, avg(y::DOUBLE) AS base FROM t_split WHERE split = 'test' GROUP BY field) c USING (field)
 JOIN (SELECT field, max(lo) FILTER (WHERE b = 'volume') AS lv, max(hi) FILTER (WHERE b = 'volume') AS hv, max(lo) FILTER (WHERE b = 'reach') AS lr, max(hi) FILTER (WHERE b = 'reach') AS hr FROM t_bpool WHERE a = 'overlap' GROUP BY field) d USING (field)""")


def placebo_ap(spark, sf):
    return M.average_precision(PD.placebo(spark, sf).where("split = 'test'").select("field", "seed", "y", F.col("eo").alias("score")), ["field", "seed"])


def branch_inputs(spark, sf):
    """Best of the two one-sided rankings, the overlap ranking, the placebo band and the paired interval."""
    m = aps(spark, sf).groupBy("field").pivot("model", ["volume", "reach", "overlap"]).agg(F.avg("value"))
    band = placebo_ap(spark, sf).groupBy("field").agg(F.avg("ap").alias("band"))
    base = S.split(spark, sf).where("split = 'test'").groupBy("field").agg(F.avg("y").alias("base"))
    ci = pooled(spark, sf).where("a = 'overlap'").select("field", F.col("b").alias("best_model"), "lo", "hi")
    best = F.when(F.col("volume") >= F.col("reach"), "volume").otherwise("reach")
    return (m.withColumn("best_model", best).withColumn("best", F.greatest("volume", "reach")).withColumnRenamed("overlap", "m1")
            .join(band, "field").join(base, "field").join(ci, ["field", "best_model"]).select("field", "best_model", "best", "m1", "band", "base", "lo", "hi"))


BRANCH_SQL = "CASE WHEN best <= band + 0.05::DOUBLE AND lo > 0 THEN 'A' WHEN (lo <= 0 AND hi >= 0) OR best >= m1 - 0.05::DOUBLE THEN 'B' ELSE 'C' END"


@query("branch_rule", f"SELECT field, best_model, round(best, 6) AS best, round(m1, 6) AS m1, round(band, 6) AS band, {BRANCH_SQL} AS branch FROM t_branch")
def branch_rule(spark, sf):
    b = branch_inputs(spark, sf)
    c = I.branch(F.col("best"), F.col("m1"), F.col("band"), F.col("lo"), F.col("hi"))
    return rounded(b, ["field", "best_model", c.alias("branch")], ["best", "m1", "band"])


@query("branch_geometry", """
SELECT field, round(band + 0.05::DOUBLE, 6) AS a_hi, round(m1 - 0.05::DOUBLE, 6) AS b_lo, band + 0.05::DOUBLE >= m1 - 0.05::DOUBLE AS regions_overlap, best <= band + 0.05::DOUBLE AND best >= m1 - 0.05::DOUBLE AS order_decides,
 round((best - base) / nullif(m1 - base, 0), 6) AS recovered_share, round((m1 - best) / nullif(m1 - base, 0), 6) AS residual_share, round(band + 0.05::DOUBLE - best, 6) AS slack FROM t_branch""")
def branch_geometry(spark, sf):
    b = branch_inputs(spark, sf)
    best, m1, band, base = (F.col(c) for c in ("best", "m1", "band", "base"))
    span = F.nullif(m1 - base, F.lit(0.0))
    return b.select("field", r6(band + 0.05).alias("a_hi"), r6(m1 - 0.05).alias("b_lo"), (band + 0.05 >= m1 - 0.05).alias("regions_overlap"), ((best <= band + 0.05) & (best >= m1 - 0.05)).alias("order_decides"),
                    r6((best - base) / span).alias("recovered_share"), r6((m1 - best) / span).alias("residual_share"), r6(band + 0.05 - best).alias("slack"))


cte("t_theta", f"SELECT field, theta, split, subject, ({jac('late_tags', 'source_tags')} > theta)::INT AS y, early_overlap, early_prod, source_breadth FROM t_split, {THETA_SQL}")


def theta_rows(spark, sf):
    """Every row with its label under each threshold: the sweep is a column, not a loop of jobs."""
    return S.split(spark, sf).withColumn("j", jaccard(F.col("late_tags"), F.col("source_tags"))).withColumn("theta", F.explode(theta_array())).select(
        "field", "theta", "split", "subject", (F.col("j") > F.col("theta")).cast("int").alias("y"), "early_overlap", "early_prod", "source_breadth")


T_AP = {c: ap_sql(f"(SELECT field, theta, y, {c}::DOUBLE AS score FROM t_theta WHERE split = 'test') q", ["field", "theta"]) for c in ("early_overlap", "early_prod")}
cte("t_tbranch", f"""SELECT field, theta, round(a.ap, 6) AS m1, round(b.ap, 6) AS best, CASE WHEN a.ap - b.ap > 0.05::DOUBLE THEN 'A' WHEN b.ap >= a.ap - 0.05::DOUBLE AND b.ap <= a.ap THEN 'B' ELSE 'C' END AS branch
 FROM ({T_AP['early_overlap']}) a JOIN ({T_AP['early_prod']}) b USING (field, theta)""")


def theta_branches(spark, sf):
    t = theta_rows(spark, sf).where("split = 'test'")

    def ap(c, name):
        return M.average_precision(t.select("field", "theta", "y", F.col(c).cast("double").alias("score")), ["field", "theta"]).select("field", "theta", F.col("ap").alias(name))
    j = ap("early_overlap", "m1").join(ap("early_prod", "best"), ["field", "theta"])
    b = F.when(F.col("m1") - F.col("best") > 0.05, "A").when((F.col("best") >= F.col("m1") - 0.05) & (F.col("best") <= F.col("m1")), "B").otherwise("C")
    return j.select("field", "theta", r6(F.col("m1")).alias("m1"), r6(F.col("best")).alias("best"), b.alias("branch"))


@query("branch_stability", """
SELECT t.field, count(DISTINCT t.branch) = 1 AS stable_all, bool_and(t.branch = r.branch) FILTER (WHERE t.theta IN (0.15::DOUBLE, 0.25::DOUBLE)) AS stable_adjacent, count(*) FILTER (WHERE t.branch <> r.branch) AS cells_moved
FROM t_tbranch t JOIN (SELECT field, branch FROM t_tbranch WHERE theta = 0.2::DOUBLE) r ON r.field = t.field GROUP BY t.field""")
def branch_stability(spark, sf):
    t = theta_branches(spark, sf)
    ref = t.where("theta = 0.2D").select("field", F.col("branch").alias("ref"))
    same = F.col("branch") == F.col("ref")
    return t.join(ref, "field").groupBy("field").agg((F.count_distinct("branch") == 1).alias("stable_all"), F.bool_and(F.when(F.col("theta").isin(0.15, 0.25), same)).alias("stable_adjacent"), F.count_if(~same).alias("cells_moved"))


KS, FLOORS = (5, 10, 15, 20), (0.3, 0.6)
cte("t_sscore", """SELECT subject, event_id, period, tag, score, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, line, part, source) AS INTEGER) AS tag_pos
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, tag ORDER BY score DESC, line, part, source) AS rn FROM t_lines WHERE score >= 0.3::DOUBLE) x WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, line, part, source) <= 3""")
cte("t_ascore", """SELECT source, event_id, period, tag, score, CAST(row_number() OVER (PARTITION BY source, event_id ORDER BY score DESC, line, part) AS INTEGER) AS tag_pos
FROM (SELECT *, row_number() OVER (PARTITION BY source, event_id, tag ORDER BY score DESC, line, part) AS rn FROM t_lines WHERE score >= 0.3::DOUBLE) x WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY source, event_id ORDER BY score DESC, line, part) <= 3""")
cte("t_vs", """SELECT subject, fl, k, win, list_sort(list(tag)) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY subject, fl, win ORDER BY n DESC, p, e, i) AS rn FROM (
 SELECT c.subject, fl, CASE WHEN t.period <= c.t0+5 THEN 'early' ELSE 'late' END AS win, tag, count(*) AS n, min(period) AS p, arg_min(event_id, (period::HUGEINT*1000000000000 + event_id)*10 + tag_pos) AS e, arg_min(tag_pos, (period::HUGEINT*1000000000000 + event_id)*10 + tag_pos) AS i
 FROM t_cohort c JOIN t_sscore t ON t.subject = c.subject AND t.period <= c.t0+15, (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) f(fl) WHERE t.score >= fl GROUP BY ALL) z) y, (VALUES (5), (10), (15), (20)) g(k) WHERE rn <= k GROUP BY ALL""")
cte("t_va", """SELECT source, cut, fl, k, list_sort(list(tag)) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY source, cut, fl ORDER BY n DESC, p, e, i) AS rn FROM (
 SELECT c.source, c.cut, fl, tag, count(*) AS n, min(period) AS p, arg_min(event_id, (period::HUGEINT*1000000000000 + event_id)*10 + tag_pos) AS e, arg_min(tag_pos, (period::HUGEINT*1000000000000 + event_id)*10 + tag_pos) AS i
 FROM (SELECT DISTINCT source, t0+5 AS cut FROM t_cohort) c JOIN t_ascore t ON t.source = c.source AND t.period <= c.cut, (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) f(fl) WHERE t.score >= fl GROUP BY ALL) z) y, (VALUES (5), (10), (15), (20)) g(k) WHERE rn <= k GROUP BY ALL""")
VJ = "CASE WHEN len(coalesce({a}, []))=0 OR len(coalesce({b}, []))=0 THEN 0.0::DOUBLE ELSE len(list_intersect({a},{b}))::DOUBLE/len(list_distinct({a} || {b})) END"
cte("t_variants", f"""SELECT c.field, c.subject, fl AS min_score, k, {VJ.format(a='e.tags', b='a.tags')} AS early_overlap, {VJ.format(a='l.tags', b='a.tags')} AS late_overlap
FROM t_cohort c CROSS JOIN (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) f(fl) CROSS JOIN (VALUES (5), (10), (15), (20)) g(k)
LEFT JOIN t_vs e ON e.subject = c.subject AND e.fl = f.fl AND e.k = g.k AND e.win = 'early' LEFT JOIN t_vs l ON l.subject = c.subject AND l.fl = f.fl AND l.k = g.k AND l.win = 'late'
LEFT JOIN t_va a ON a.source = c.source AND a.cut = c.t0+5 AND a.fl = f.fl AND a.k = g.k""".replace("fl AS min_score", "f.fl AS min_score").replace("k, CASE", "g.k AS k, CASE", 1))


def variants(spark, sf):
    """Overlaps rebuilt at every (score floor, k). Raising the floor only shortens an event's stored
    list, so all floors share one scan and all k share one ranking."""
    def build():
        c = S.cohort(spark, sf).select("field", "subject", "source", "t0")
        floors = F.array(*[F.lit(f) for f in FLOORS])

        def with_floor(t):
            return t.withColumn("min_score", F.explode(F.filter(floors, lambda f: f <= F.col("tag_score"))))
        t = with_floor(S.subject_tags(spark, sf).join(c.select("subject", "t0"), "subject").where(F.col("period") <= F.col("t0") + 15))
        t = t.withColumn("win", F.when(F.col("period") <= F.col("t0") + 5, "early").otherwise("late"))
        ks = ["subject", "min_score", "win"]
        s = profiles.profile_grid(profiles.tag_counts(t, ks), ks, KS)
        cuts = c.select("source", (F.col("t0") + 5).alias("cut")).distinct()
        a = with_floor(S.source_tags(spark, sf).join(cuts, "source").where(F.col("period") <= F.col("cut")))
        ka = ["source", "cut", "min_score"]
        a = profiles.profile_grid(profiles.tag_counts(a, ka), ka, KS, "source_tags")
        grid = c.withColumn("min_score", F.explode(floors)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in KS]))).withColumn("cut", F.col("t0") + 5)

        def side(w):
            return s.where(F.col("win") == w).select("subject", "min_score", "k", F.col("tags").alias(w))
        j = grid.join(side("early"), ["subject", "min_score", "k"], "left").join(side("late"), ["subject", "min_score", "k"], "left").join(a, ["source", "cut", "min_score", "k"], "left")
        return j.select("field", "subject", "min_score", "k", jaccard(F.col("early"), F.col("source_tags")).alias("early_overlap"), jaccard(F.col("late"), F.col("source_tags")).alias("late_overlap"))
    return S.stage(spark, sf, "variants", build)


@query("sweep_merge", f"""
SELECT v.field, min_score, k, theta, count(*) AS n, round(avg((late_overlap > theta)::INT::DOUBLE), 6) AS base_rate, round(avg(early_overlap), 6) AS mean_early FROM t_variants v, {THETA_SQL} GROUP BY ALL""")
def sweep_merge(spark, sf):
    """(field x floor x k x theta) grid in one job."""
    v = variants(spark, sf).withColumn("theta", F.explode(theta_array()))
    return v.groupBy("field", "min_score", "k", "theta").agg(n_rows(), r6(F.avg((F.col("late_overlap") > F.col("theta")).cast("int"))).alias("base_rate"), r6(F.avg("early_overlap")).alias("mean_early"))


@query("certificate_scramble", """
SELECT field, round(g, 6) AS global_auc, round(c, 6) AS cell_auc, round(ap, 6) AS global_ap, round(base, 6) AS base_rate,
 CASE WHEN abs(g - 0.5::DOUBLE) <= 0.035::DOUBLE AND abs(c - 0.5::DOUBLE) <= 0.035::DOUBLE AND abs(ap - base) <= 0.03::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM (SELECT field, avg(auc) FILTER (WHERE variant = 'global') AS g, avg(auc) FILTER (WHERE variant = 'cell') AS c FROM t_scrauc GROUP BY field) a JOIN (SELECT field, avg(ap) AS ap FROM t_scrap WHERE variant = 'global' GROUP BY field) b USING (field)
JOIN (SELECT field, avg(y::DOUBLE) AS base FROM t_split GROUP BY field) d USING (field)""")
def certificate_scramble(spark, sf):
    k = ["variant", "field", "seed"]
    auc = M.auc_roc(scrambles(spark, sf), k).groupBy("field").pivot("variant", ["global", "cell"]).agg(F.avg("auc"))
    ap = M.average_precision(scrambles(spark, sf).where("variant = 'global'"), k).groupBy("field").agg(F.avg("ap").alias("ap"))
    base = S.split(spark, sf).groupBy("field").agg(F.avg("y").alias("base"))
    ok = (F.abs(F.col("global") - 0.5) <= 0.035) & (F.abs(F.col("cell") - 0.5) <= 0.035) & (F.abs(F.col("ap") - F.col("base")) <= 0.03)
    return auc.join(ap, "field").join(base, "field").select("field", r6(F.col("global")).alias("global_auc"), r6(F.col("cell")).alias("cell_auc"), r6(F.col("ap")).alias("global_ap"), r6(F.col("base")).alias("base_rate"), F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


cte("t_disap", ap_sql("(SELECT d.field, y, early_overlap AS score FROM t_disjoint d JOIN t_cohort USING (subject) WHERE split = 'test') q", ["field"]))


@query("certificate_disjoint", "SELECT field, round(t.ap, 6) AS temporal_ap, round(d.ap, 6) AS disjoint_ap, round(d.ap - t.ap, 6) AS shift, CASE WHEN d.ap - t.ap >= -0.05::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS verdict FROM t_trueap t JOIN t_disap d USING (field)")
def certificate_disjoint(spark, sf):
    t = true_ap(spark, sf)
    d = M.average_precision(PD.disjoint(spark, sf).where("split = 'test'").select("field", "y", F.col("early_overlap").alias("score")), ["field"])
    j = t.select("field", F.col("ap").alias("a")).join(d.select("field", F.col("ap").alias("b")), "field")
    return j.select("field", r6(F.col("a")).alias("temporal_ap"), r6(F.col("b")).alias("disjoint_ap"), r6(F.col("b") - F.col("a")).alias("shift"), F.when(F.col("b") - F.col("a") >= -0.05, "PASS").otherwise("FAIL").alias("verdict"))


def true_ap(spark, sf):
    return M.average_precision(S.split(spark, sf).where("split = 'test'").select("field", "y", F.col("early_overlap").alias("score")), ["field"])


cte("t_pdiff", "SELECT p.field, 'true' AS a, 'placebo' AS b, CAST(p.seed AS INTEGER) AS seed, round(t.ap, 6) AS va, round(p.ap, 6) AS vb, round(round(t.ap, 6) - round(p.ap, 6), 6) AS d FROM t_plap p JOIN t_trueap t USING (field)")
cte("t_pwil", wil_sql("t_pdiff", ["field", "a", "b"]))
cte("t_pbh", bh_sql("(SELECT *, 1 AS fam FROM t_pwil) w", ["fam"], ["field"]))


@query("certificate_placebo", "SELECT field, round(mean_a, 6) AS true_ap, round(mean_b, 6) AS placebo_ap, round(mean_diff, 6) AS gap, round(p, 6) AS p, round(p_adj, 6) AS p_adj FROM t_pbh")
def certificate_placebo(spark, sf):
    """True ranking against the same ranking fed with drawn donors' profiles; one family over fields."""
    j = placebo_ap(spark, sf).select("field", "seed", r6(F.col("ap")).alias("vb")).join(true_ap(spark, sf).select("field", r6(F.col("ap")).alias("va")), "field")
    d = j.withColumn("d", F.round(F.col("va") - F.col("vb"), 6))
    t = I.bh(I.wilcoxon(d, ["field"]).withColumn("fam", F.lit(1)), ["fam"], ["field"])
    return t.select("field", r6(F.col("mean_a")).alias("true_ap"), r6(F.col("mean_b")).alias("placebo_ap"), r6(F.col("mean_diff")).alias("gap"), r6(F.col("p")).alias("p"), r6(F.col("p_adj")).alias("p_adj"))


def excess_sql(src):
    a = ap_sql(src, ["field", "seed"])
    return f"""SELECT field, round(avg(e), 6) AS excess_mean, round(quantile_cont(e, 0.025), 6) AS lo, round(quantile_cont(e, 0.975), 6) AS hi, quantile_cont(e, 0.025) > 0 AS excludes_zero FROM (SELECT field, seed, round(t.ap - s.ap, 9) AS e FROM ({a}) s JOIN t_trueap t USING (field)) x GROUP BY field"""


def excess(spark, sf, rows):
    a = M.average_precision(rows, ["field", "seed"]).select("field", "seed", F.col("ap").alias("sap")).join(true_ap(spark, sf).select("field", "ap"), "field")
    e = a.withColumn("e", F.round(F.col("ap") - F.col("sap"), 9))
    m = e.groupBy("field").agg(r6(F.avg("e")).alias("excess_mean"))
    q = quantiles(e, ["field"], "e", {"lo": 0.025, "hi": 0.975})
    return m.join(q, "field").select("field", "excess_mean", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), (F.col("lo") > 0).alias("excludes_zero"))


@query("certificate_swap", excess_sql("(SELECT field, seed, y_swap AS y, eo AS score FROM t_swap WHERE split = 'test') q"))
def certificate_swap(spark, sf):
    """Label and feature of the control share the same drawn donor, at the true base rate."""
    return excess(spark, sf, PD.swap_labels(spark, sf).where("split = 'test'").select("field", "seed", F.col("y_swap").alias("y"), F.col("eo").alias("score")))


@query("swap_excess_grid", excess_sql("(SELECT p.field, p.seed, (lo > theta)::INT AS y, eo AS score FROM t_placebo p JOIN t_grid g ON g.field = p.field AND g.seed = p.seed WHERE split = 'test') q"))
def swap_excess_grid(spark, sf):
    p = PD.placebo(spark, sf).where("split = 'test'").join(PD.calibrate_grid(spark, sf), ["field", "seed"])
    return excess(spark, sf, p.select("field", "seed", (F.col("lo") > F.col("theta")).cast("int").alias("y"), F.col("eo").alias("score")))


def o_ap(c):
    return ap_sql(f"(SELECT r.field, origin, r.y, c.{c}::DOUBLE AS score FROM t_rolling r JOIN t_cohort c ON c.subject = r.subject WHERE split = 'test') q", ["field", "origin"])


@query("origin_sign_stability", f"""
SELECT field, count(*) AS origins, round(avg(a.ap - b.ap), 6) AS mean_delta, bool_and(a.ap > b.ap) AS all_positive, bool_or(a.ap > b.ap) AS any_positive
FROM ({o_ap('early_overlap')}) a JOIN ({o_ap('early_prod')}) b USING (field, origin) GROUP BY field""")
def origin_sign_stability(spark, sf):
    t = PD.rolling(spark, sf).where("split = 'test'")

    def ap(c, n):
        return M.average_precision(t.select("field", "origin", "y", F.col(c).cast("double").alias("score")), ["field", "origin"]).select("field", "origin", F.col("ap").alias(n))
    j = ap("early_overlap", "a").join(ap("early_prod", "b"), ["field", "origin"])
    up = F.col("a") > F.col("b")
    return j.groupBy("field").agg(n_rows("origins"), r6(F.avg(F.col("a") - F.col("b"))).alias("mean_delta"), F.bool_and(up).alias("all_positive"), F.bool_or(up).alias("any_positive"))


@query("topk_importance_agree", """
WITH f AS (SELECT field, theta, name, abs(covar_pop(v, y::DOUBLE) / nullif(stddev_pop(v) * stddev_pop(y::DOUBLE), 0)) AS imp FROM (
  SELECT field, theta, y, unnest(['overlap', 'prod', 'breadth']) AS name, unnest([early_overlap, early_prod::DOUBLE, source_breadth::DOUBLE]) AS v FROM t_theta) x GROUP BY ALL),
s AS (SELECT field, theta, array_to_string(list_sort(list(name)), ',') AS top2 FROM (SELECT *, row_number() OVER (PARTITION BY field, theta ORDER BY round(coalesce(imp, 0), 9) DESC, name) AS rn FROM f) y WHERE rn <= 2 GROUP BY ALL)
SELECT field, count(DISTINCT top2) = 1 AS agree, count(DISTINCT top2) AS n_sets FROM s GROUP BY field""")
def topk_importance_agree(spark, sf):
    """Is the set of the two strongest features the same under every threshold?"""
    feats = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in (("overlap", "early_overlap"), ("prod", "early_prod"), ("breadth", "source_breadth"))])
    f = theta_rows(spark, sf).select("field", "theta", "y", F.explode(feats).alias("f")).groupBy("field", "theta", "f.name").agg(F.round(F.coalesce(F.abs(stats.corr(F.col("f.v"), F.col("y"))), F.lit(0.0)), 9).alias("imp"))
    rn = F.row_number().over(W.partitionBy("field", "theta").orderBy(F.col("imp").desc(), "name"))
    top = f.withColumn("rn", rn).where("rn <= 2").groupBy("field", "theta").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("top2"))
    return top.groupBy("field").agg((F.count_distinct("top2") == 1).alias("agree"), F.count_distinct("top2").alias("n_sets"))


@query("extra_rung_screen", "SELECT field, a AS candidate, bool_and(mean_diff > 0 AND p < 0.05::DOUBLE) AS beats_both FROM t_wil WHERE a = 'overlap' GROUP BY ALL")
def extra_rung_screen(spark, sf):
    t = tests(spark, sf).where("a = 'overlap'")
    return t.groupBy("field", F.col("a").alias("candidate")).agg(F.bool_and((F.col("mean_diff") > 0) & (F.col("p") < 0.05)).alias("beats_both"))


cte("t_hh", """SELECT field, 'overlap' AS a, b, seed, va, vb, round(va - vb, 6) AS d FROM (SELECT x.field, x.seed, x.value AS va, y.b, y.vb FROM t_ap x JOIN (
  SELECT field, seed, model AS b, value AS vb FROM t_ap WHERE model <> 'overlap' UNION ALL SELECT field, seed, 'ceiling', max(value) FROM t_ap WHERE model <> 'overlap' GROUP BY field, seed) y ON y.field = x.field AND y.seed = x.seed WHERE x.model = 'overlap') z""")
cte("t_hhw", wil_sql("t_hh", ["field", "b"]))
cte("t_hhb", bh_sql("t_hhw", ["field"], ["b"]))


def head_rows(spark, sf):
    a = aps(spark, sf)
    rest = a.where("model <> 'overlap'")
    bases = rest.select("field", "seed", F.col("model").alias("b"), F.col("value").alias("vb")).unionByName(
        rest.groupBy("field", "seed").agg(F.max("value").alias("vb")).withColumn("b", F.lit("ceiling")).select("field", "seed", "b", "vb"))
    return a.where("model = 'overlap'").select("field", "seed", F.col("value").alias("va")).join(bases, ["field", "seed"]).withColumn("d", F.round(F.col("va") - F.col("vb"), 6))


@query("head_to_head", "SELECT h.field, h.b, round(mean_diff, 6) AS mean_diff, round(p_adj, 6) AS p_adj, round(c.lo, 6) AS lo, round(c.hi, 6) AS hi FROM t_hhb h LEFT JOIN t_bpool c ON c.field = h.field AND c.b = h.b AND c.a = 'overlap'")
def head_to_head(spark, sf):
    """One model against three bases: test, one family of three, and the paired interval over all seeds."""
    t = I.bh(I.wilcoxon(head_rows(spark, sf), ["field", "b"]), ["field"], ["b"])
    q = pooled(spark, sf).where("a = 'overlap'").select("field", "b", "lo", "hi")
    return t.join(q, ["field", "b"], "left").select("field", "b", *[r6(F.col(c)).alias(c) for c in ("mean_diff", "p_adj", "lo", "hi")])


cte("t_comp", """SELECT x.field, x.seed, m.b, x.value AS va, m.vb, round(x.value - m.vb, 6) AS d FROM t_ap x JOIN (SELECT field, seed, 'stochastic' AS b, value AS vb FROM t_ap WHERE model = 'reach'
 UNION ALL SELECT t.field, r.s, 'fixed', t.value FROM (SELECT field, round(avg(value) + 1e-9::DOUBLE, 5) AS value FROM t_ap WHERE model = 'volume' GROUP BY field) t, range(10) r(s)) m ON m.field = x.field AND m.seed = x.seed WHERE x.model = 'overlap'""")
cte("t_compw", wil_sql("t_comp", ["field", "b"]))
cte("t_compb", bh_sql("t_compw", ["field"], ["b"]))


@query("paired_vs_components", """
SELECT field, b, round(mean_diff, 6) AS mean_diff, n_pos, n_neg, round(p_adj, 6) AS p_adj, CASE WHEN var_b = 0 THEN 'one-sample' ELSE 'paired' END AS test_kind, rank() OVER (PARTITION BY field ORDER BY mean_b DESC) = 1 AS is_ceiling FROM t_compb""")
def paired_vs_components(spark, sf):
    """Against each part of a ceiling; a part without seed variance makes the test one-sample."""
    a = aps(spark, sf)
    x = a.where("model = 'overlap'").select("field", "seed", F.col("value").alias("va"))
    s = a.where("model = 'reach'").select("field", "seed", F.lit("stochastic").alias("b"), F.col("value").alias("vb"))
    f = a.where("model = 'volume'").groupBy("field").agg(F.round(F.avg("value") + 1e-9, 5).alias("value")).select("field", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seed"), F.lit("fixed").alias("b"), F.col("value").alias("vb"))
    d = x.join(s.unionByName(f), ["field", "seed"]).withColumn("d", F.round(F.col("va") - F.col("vb"), 6))
    t = I.bh(I.wilcoxon(d, ["field", "b"]), ["field"], ["b"])
    return t.select("field", "b", r6(F.col("mean_diff")).alias("mean_diff"), "n_pos", "n_neg", r6(F.col("p_adj")).alias("p_adj"), F.when(F.col("var_b") == 0, "one-sample").otherwise("paired").alias("test_kind"),
                    (F.rank().over(W.partitionBy("field").orderBy(F.col("mean_b").desc())) == 1).alias("is_ceiling"))


ABL = [("reach", "overlap"), ("volume", "overlap")]
cte("t_abl", "SELECT x.field, x.model AS a, y.model AS b, x.seed, x.value AS va, y.value AS vb, round(x.value - y.value, 6) AS d FROM t_ap x JOIN t_ap y ON y.field = x.field AND y.seed = x.seed AND y.model = 'overlap' WHERE x.model <> 'overlap'")
cte("t_ablw", wil_sql("t_abl", ["field", "a", "b"]))
cte("t_ablb", bh_sql("t_ablw", ["field"], ["a"]))
cte("t_ablc", seedboot_sql("t_abl", ["field", "a", "b"]))


@query("ablation_tests", """
SELECT field, a AS ablation, round(t.mean_diff, 6) AS mean_diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p_adj, 6) AS p_adj, round(t.mean_diff / nullif(sd_diff, 0), 5) AS d,
 CASE WHEN p_adj <= 0.05::DOUBLE AND (lo > 0 OR hi < 0) THEN 'supported' ELSE 'not significant' END AS verdict FROM t_ablb t JOIN t_ablc c USING (field, a, b)""")
def ablation_tests(spark, sf):
    """Each ablation against the full model."""
    d = I.paired_differences(aps(spark, sf), ["field"], "model", ABL)
    t = I.bh(I.wilcoxon(d, ["field", "a", "b"]), ["field"], ["a"])
    c = I.seed_bootstrap(d, ["field", "a", "b"], SEED_DRAWS).select("field", "a", "lo", "hi")
    ok = (F.col("p_adj") <= 0.05) & ((F.col("lo") > 0) | (F.col("hi") < 0))
    return t.join(c, ["field", "a"]).select("field", F.col("a").alias("ablation"), *[r6(F.col(x)).alias(x) for x in ("mean_diff", "lo", "hi", "p_adj")], F.round(I.cohens_d(F.col("mean_diff"), F.col("sd_diff")), 5).alias("d"), F.when(ok, "supported").otherwise("not significant").alias("verdict"))


cte("t_loc", """SELECT 'full' AS family, field, a, seed, va, vb, d FROM t_abl UNION ALL
SELECT 'ceiling', x.field, x.model, x.seed, x.value, c.vb, round(x.value - c.vb, 6) FROM t_ap x JOIN (SELECT field, seed, min(value) AS vb FROM t_ap GROUP BY ALL) c ON c.field = x.field AND c.seed = x.seed""")
cte("t_locw", wil_sql("t_loc", ["family", "field", "a"]))
cte("t_locb", bh_sql("t_locw", ["family", "field"], ["a"]))


@query("edge_localisation", """
SELECT field, bool_and(p_adj > 0.05::DOUBLE) FILTER (WHERE family = 'full') AS no_drop_significant, bool_and(mean_diff > 0) FILTER (WHERE family = 'ceiling' AND a <> 'overlap') AS every_drop_above_ceiling,
 round(sum(mean_diff) FILTER (WHERE family = 'full'), 6) AS sum_of_drops FROM t_locb GROUP BY field""")
def edge_localisation(spark, sf):
    """Two families in one pass: drops against the full model, all variants against a floor ceiling."""
    a = aps(spark, sf)
    full = I.paired_differences(a, ["field"], "model", ABL).select(F.lit("full").alias("family"), "field", "a", "seed", "va", "vb", "d")
    floor = a.groupBy("field", "seed").agg(F.min("value").alias("vb"))
    ceil = a.join(floor, ["field", "seed"]).select(F.lit("ceiling").alias("family"), "field", F.col("model").alias("a"), "seed", F.col("value").alias("va"), "vb", F.round(F.col("value") - F.col("vb"), 6).alias("d"))
    k = ["family", "field", "a"]
    t = I.bh(I.wilcoxon(full.unionByName(ceil), k), ["family", "field"], ["a"])
    f = F.col("family") == "full"
    return t.groupBy("field").agg(F.bool_and(F.when(f, F.col("p_adj") > 0.05)).alias("no_drop_significant"), F.bool_and(F.when(~f & (F.col("a") != "overlap"), F.col("mean_diff") > 0)).alias("every_drop_above_ceiling"),
                                  r6(F.sum(F.when(f, F.col("mean_diff")))).alias("sum_of_drops"))


@query("external_scores_verdict", """
SELECT field, missing_rows, unknown_rows, mean_a > mean_b AS gate_mean, p_adj < 0.05::DOUBLE AS gate_p, lo > 0 AS gate_ci, mean_a > mean_b AND p_adj < 0.05::DOUBLE AND lo > 0 AS exceeds
FROM t_bh JOIN t_bpool USING (field, a, b) JOIN (SELECT field, 10 * count(*) FILTER (WHERE subject % 7 = 0) AS missing_rows, 10 * count(*) FILTER (WHERE subject % 11 = 0) AS unknown_rows FROM t_split WHERE split = 'test' GROUP BY field) m USING (field)
WHERE a = 'reach' AND b = 'volume'""")
def external_scores_verdict(spark, sf):
    """Foreign scores are read from their files and aligned by row id first; rows missing on either side are counted, then
    gated. The files are written here: rows of every seventh subject are left out, and some ids are nobody's."""
    root = scratch(spark, "foreign")
    own = S.scores(spark, sf).where("model = 'reach' and split = 'test'").select("field", "seed", "subject", "score")
    own.where("subject % 7 <> 0").unionByName(own.where("subject % 11 = 0").withColumn("subject", -F.col("subject") - 1)).write.option("header", True).csv(root)
    foreign = spark.read.schema(own.schema).option("header", True).csv(root).select("field", "seed", "subject")
    frozen = S.split(spark, sf).where("split = 'test'").select("field", "subject").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(9))))
    both = (frozen.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(foreign.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
            .groupBy("field", "seed", "subject").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    al = both.groupBy("field").agg(F.count_if(F.col("b") == 0).alias("missing_rows"), F.count_if(F.col("a") == 0).alias("unknown_rows"))
    j = tests(spark, sf).where("a = 'reach' and b = 'volume'").join(pooled(spark, sf), ["field", "a", "b"]).join(al, "field")
    g = I.gates(F.col("mean_a"), F.col("mean_b"), F.col("p_adj"), F.col("lo"))
    return j.select("field", "missing_rows", "unknown_rows", *[c.alias(n) for n, c in g.items()])


@query("origin_collect", """
WITH grid AS (SELECT field, origin, CAST(s AS INTEGER) AS seed FROM t_origins, range(10) r(s)), runs AS (SELECT DISTINCT field, origin, CAST(s AS INTEGER) AS seed FROM t_rolling, range(10) r(s) WHERE split = 'test' AND y = 1)
SELECT g.field, g.origin, g.seed FROM grid g LEFT JOIN runs r ON r.field = g.field AND r.origin = g.origin AND r.seed = g.seed WHERE r.field IS NULL""")
def origin_collect(spark, sf):
    """Cells of the (field, origin, seed) grid without a run (a run needs a positive test row); a merge is
    refused while any is listed."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seed")
    grid = PD.origins(spark, sf).select("field", "origin", seeds)
    runs = PD.rolling(spark, sf).where("split = 'test' and y = 1").select("field", "origin").distinct().select("field", "origin", seeds)
    return grid.join(runs, ["field", "origin", "seed"], "left_anti")


@query("perseed_merge", "SELECT field, model, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n_seeds, 10 - count(*) AS missing_seeds FROM t_ap WHERE NOT (model = 'reach' AND seed >= 7) GROUP BY ALL")
def perseed_merge(spark, sf):
    """Partial per-seed rows from two runs merged into the standard summary; the second run stopped early."""
    a = aps(spark, sf).where("model <> 'reach'")
    b = aps(spark, sf).where("model = 'reach' and seed < 7")
    s = stats.seed_summary(a.unionByName(b).dropDuplicates(KEYS), ["field", "model"])
    return s.select("field", "model", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"), "n_seeds", (10 - F.col("n_seeds")).alias("missing_seeds"))


@query("attribution_2x2", """
SELECT field, round(b - a, 6) AS b_minus_a, round(e - b, 6) AS e_minus_b, round(f - b, 6) AS f_minus_b, round(c - b, 6) AS c_minus_b, round(abs((e - b) + (f - b) - (c - b)), 6) AS additivity_gap, abs((e - b) + (f - b) - (c - b)) <= 0.0013::DOUBLE AS within_floor FROM (
 SELECT field, avg(early_overlap) FILTER (WHERE k = 5 AND min_score = 0.6::DOUBLE) AS b, avg(late_overlap) FILTER (WHERE k = 5 AND min_score = 0.6::DOUBLE) AS a, avg(early_overlap) FILTER (WHERE k = 10 AND min_score = 0.6::DOUBLE) AS e,
 avg(early_overlap) FILTER (WHERE k = 5 AND min_score = 0.3::DOUBLE) AS f, avg(early_overlap) FILTER (WHERE k = 10 AND min_score = 0.3::DOUBLE) AS c FROM t_variants GROUP BY field) x""")
def attribution_2x2(spark, sf):
    """Two switches (k, floor): effect of each alone, of both, and the additivity gap against a floor."""
    k, m, e = F.col("k"), F.col("min_score"), F.col("early_overlap")

    def cell(kk, mm, col=e):
        return F.avg(F.when((k == kk) & (m == mm), col))
    g = variants(spark, sf).groupBy("field").agg(cell(5, 0.6).alias("b"), cell(5, 0.6, F.col("late_overlap")).alias("a"), cell(10, 0.6).alias("e"), cell(5, 0.3).alias("f"), cell(10, 0.3).alias("c"))
    a, b, c, e_, f = (F.col(x) for x in "abcef")
    gap = F.abs((e_ - b) + (f - b) - (c - b))
    return g.select("field", r6(b - a).alias("b_minus_a"), r6(e_ - b).alias("e_minus_b"), r6(f - b).alias("f_minus_b"), r6(c - b).alias("c_minus_b"), r6(gap).alias("additivity_gap"), (gap <= 0.0013).alias("within_floor"))


@query("linstr_interval", f"""
SELECT x.field, round(max(abs(x.ap - t.value)), 6) AS max_rebuild_gap, max(abs(x.ap - t.value)) <= 0.00001::DOUBLE AS reproduced, any_value(round(lo, 6)) AS lo, any_value(round(hi, 6)) AS hi
FROM ({ap_sql("t_scores", KEYS, where="split = 'test'")}) x JOIN t_ap t ON t.field = x.field AND t.model = x.model AND t.seed = x.seed JOIN t_bpool p ON p.field = x.field AND p.a = 'overlap' AND p.b = 'reach' WHERE x.model IN ('overlap', 'reach') GROUP BY x.field""")
def linstr_interval(spark, sf):
    """The recorded APs must be reproduced from the stored scores before the paired interval is given."""
    two = F.col("model").isin("overlap", "reach")
    again = M.average_precision(test_scores(spark, sf).where(two), KEYS)
    g = again.join(aps(spark, sf), KEYS).groupBy("field").agg(F.max(F.abs(F.col("ap") - F.col("value"))).alias("gap"))
    p = pooled(spark, sf).where("a = 'overlap' and b = 'reach'").select("field", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))
    return g.join(p, "field").select("field", r6(F.col("gap")).alias("max_rebuild_gap"), (F.col("gap") <= 1e-5).alias("reproduced"), "lo", "hi")
