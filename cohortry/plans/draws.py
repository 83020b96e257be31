"""Splits, samples, permutations, placebo draws and threshold calibration."""

from pyspark.sql import functions as F

from cohortry.functions.columns import jaccard, keyed_md5, r6, uniform
from cohortry.operators import draws as D
from cohortry.operators.ordering import cumulate, hash_rank
from cohortry.plans import stages as S
from cohortry.plans.aggregates import n_rows, pair_graph
from cohortry.plans.joins import jac
from cohortry.plans.registry import cte, query

UNI = "(('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
HINT = "('0x' || substr(md5({k}), 1, 12))::BIGINT"


@query("split_temporal", "SELECT field, split, count(*) AS n, min(t0) AS lo, max(t0) AS hi, round(avg(y::DOUBLE), 6) AS base_rate FROM t_split GROUP BY ALL")
def split_temporal(spark, sf):
    return D.split_temporal(S.cohort(spark, sf), ["field"]).groupBy("field", "split").agg(
        n_rows(), F.min("t0").alias("lo"), F.max("t0").alias("hi"), r6(F.avg("y")).alias("base_rate"))


cte("t_disjoint", """
SELECT c.field, c.subject, c.source, CASE WHEN rn <= floor(0.6::DOUBLE*n) THEN 'train' WHEN rn <= floor((0.6::DOUBLE + 0.2::DOUBLE)*n) THEN 'val' ELSE 'test' END AS split
FROM t_cohort c JOIN (SELECT *, row_number() OVER (PARTITION BY field ORDER BY md5(concat_ws('|', 0, 'disjoint', source)), source) AS rn, count(*) OVER (PARTITION BY field) AS n
 FROM (SELECT DISTINCT field, source FROM t_cohort) d) m ON m.field = c.field AND m.source = c.source""")


def disjoint(spark, sf):
    return D.split_group_disjoint(S.cohort(spark, sf), ["field"], "source")


@query("split_group_disjoint", "SELECT field, subject, source, split FROM t_disjoint")
def split_group_disjoint(spark, sf):
    return disjoint(spark, sf).select("field", "subject", "source", "split")


@query("split_group_disjoint_check", "SELECT field, count(*) AS sources, count(*) FILTER (WHERE k > 1) AS sources_in_two_folds FROM (SELECT field, source, count(DISTINCT split) AS k FROM t_disjoint GROUP BY ALL) x GROUP BY field")
def split_group_disjoint_check(spark, sf):
    per = disjoint(spark, sf).groupBy("field", "source").agg(F.count_distinct("split").alias("k"))
    return per.groupBy("field").agg(n_rows("sources"), F.count_if(F.col("k") > 1).alias("sources_in_two_folds"))


cte("t_origins", """
SELECT field, CAST(3 - k AS INTEGER) AS origin, CAST(hi - 2*k - 1 AS INTEGER) AS test_lo, CAST(hi - 2*k AS INTEGER) AS test_hi, CAST(hi - 2*k - 3 AS INTEGER) AS val_lo, CAST(hi - 2*k - 2 AS INTEGER) AS val_hi
FROM (SELECT field, max(t0) AS hi FROM t_cohort GROUP BY field) x, range(4) r(k)""")
cte("t_rolling", """
SELECT o.field, o.origin, c.subject, c.y, c.early_overlap, c.late_overlap, CASE WHEN t0 < val_lo THEN 'train' WHEN t0 <= val_hi THEN 'val' ELSE 'test' END AS split FROM t_cohort c JOIN t_origins o ON o.field = c.field WHERE t0 <= test_hi""")


def origins(spark, sf):
    return D.rolling_origins(S.cohort(spark, sf), ["field"], "t0")


def rolling(spark, sf):
    return D.split_rolling(S.cohort(spark, sf), origins(spark, sf), ["field"], "t0")


@query("origins_from_max", "SELECT * FROM t_origins")
def origins_from_max(spark, sf):
    return origins(spark, sf)


@query("split_rolling_origin", "SELECT field, origin, split, count(*) AS n, sum(y)::BIGINT AS positives FROM t_rolling GROUP BY ALL")
def split_rolling_origin(spark, sf):
    return rolling(spark, sf).groupBy("field", "origin", "split").agg(n_rows(), F.sum("y").alias("positives"))


def perm_sql(cell, src, seed=0):
    p = ", ".join(cell)
    return f"""SELECT a.*, b.y AS y_perm FROM (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY md5(concat_ws('|', {seed}, 'permute', 'to', subject)), subject) AS ra FROM {src} WHERE split <> 'test') a
 JOIN (SELECT *, row_number() OVER (PARTITION BY {p} ORDER BY md5(concat_ws('|', {seed}, 'permute', 'from', subject)), subject) AS rb FROM {src} WHERE split <> 'test') b
 ON a.ra = b.rb AND {' AND '.join(f'a.{c} = b.{c}' for c in cell)}"""


def scrambled(spark, sf, cell, seed=0):
    """Labels permuted inside each cell of the non-test rows; test rows keep theirs."""
    c = S.split(spark, sf).select("field", "split", "t0", "subject", "y")
    moved = D.permute(c.where("split <> 'test'"), cell, "subject", "y", seed, "y_perm")
    return moved.unionByName(c.where("split = 'test'").withColumn("y_perm", F.col("y")))


@query("label_scramble_global", f"SELECT subject, y, y_perm FROM ({perm_sql(['field'], 't_split')}) x UNION ALL SELECT subject, y, y FROM t_split WHERE split = 'test'")
def label_scramble_global(spark, sf):
    return scrambled(spark, sf, ["field"]).select("subject", "y", "y_perm")


@query("label_scramble_cell", f"SELECT subject, y, y_perm FROM ({perm_sql(['field', 'split', 't0'], 't_split')}) x UNION ALL SELECT subject, y, y FROM t_split WHERE split = 'test'")
def label_scramble_cell(spark, sf):
    return scrambled(spark, sf, ["field", "split", "t0"]).select("subject", "y", "y_perm")


SEEDS = 10


def draw_sql(band):
    anchors = "(SELECT DISTINCT field, t0 AS anc FROM t_cohort)" if band is not None else "(SELECT DISTINCT field, 0 AS anc FROM t_cohort)"
    cond = f"AND abs(j.t0 - a.anc) <= {band}" if band is not None else ""
    at = "i.t0" if band is not None else "0"
    return f"""
WITH p AS (SELECT a.field, a.anc, j.subject, j.source, row_number() OVER (PARTITION BY a.field, a.anc ORDER BY md5(CAST(j.source AS VARCHAR)), j.source, j.t0, md5(CAST(j.subject AS VARCHAR)), j.subject) - 1 AS pos,
   count(*) OVER (PARTITION BY a.field, a.anc) AS pool FROM {anchors} a JOIN t_cohort j ON j.field = a.field {cond}),
b AS (SELECT field, anc, source, min(pos) AS off, count(*) AS own, any_value(pool) AS pool FROM p GROUP BY ALL),
k AS (SELECT i.field, i.subject, {at} AS anc, s AS seed, b.off, b.own, b.pool, {HINT.format(k="concat_ws('|', s, 'placebo', i.subject)")} % (b.pool - b.own) AS k
  FROM t_cohort i JOIN b ON b.field = i.field AND b.anc = {at} AND b.source = i.source, range({SEEDS}) r(s) WHERE b.pool > b.own)
SELECT k.field, k.subject, CAST(k.seed AS INTEGER) AS seed, p.subject AS donor FROM k JOIN p ON p.field = k.field AND p.anc = k.anc AND p.pos = CASE WHEN k.k >= k.off THEN k.k + k.own ELSE k.k END"""


cte("t_draw_band", draw_sql(3))
cte("t_draw_any", draw_sql(None))
cte("t_draw", "SELECT * FROM t_draw_band UNION ALL SELECT * FROM t_draw_any a WHERE NOT EXISTS (SELECT 1 FROM t_draw_band b WHERE b.subject = a.subject)")
cte("t_placebo", f"""
SELECT d.field, d.seed, d.subject, d.donor, c.split, c.y, c.early_overlap, {jac('c.early_tags', 'e.source_tags')} AS eo, {jac('c.late_tags', 'e.source_tags')} AS lo
FROM t_draw d JOIN t_split c ON c.subject = d.subject JOIN t_cohort e ON e.subject = d.donor""")


def cohort_draw(spark, sf, band=3):
    return D.placebo_draw(S.cohort(spark, sf), ["field"], "subject", "source", "t0", band, SEEDS)


def placebo(spark, sf):
    """Each (row, seed) with the profile of its drawn donor's source and both placebo overlaps."""
    def build():
        donor = S.cohort(spark, sf).select(F.col("subject").alias("donor"), F.col("source_tags").alias("donor_tags"))
        c = S.split(spark, sf).select("subject", "split", "y", "early_overlap", "early_tags", "late_tags")
        j = cohort_draw(spark, sf).join(donor, "donor").join(c, "subject")
        return j.select("field", "seed", "subject", "donor", "split", "y", "early_overlap",
                        jaccard(F.col("early_tags"), F.col("donor_tags")).alias("eo"), jaccard(F.col("late_tags"), F.col("donor_tags")).alias("lo"))
    return S.stage(spark, sf, "placebo", build)


@query("placebo_draw", "SELECT field, subject, seed, donor FROM t_draw")
def placebo_draw(spark, sf):
    return cohort_draw(spark, sf)


@query("placebo_draw_random", "SELECT field, subject, seed, donor FROM t_draw_any")
def placebo_draw_random(spark, sf):
    return cohort_draw(spark, sf, None)


@query("placebo_feature", "SELECT subject, seed, round(eo, 6) AS overlap FROM t_placebo")
def placebo_feature(spark, sf):
    return placebo(spark, sf).select("subject", "seed", r6(F.col("eo")).alias("overlap"))


@query("placebo_label", "SELECT subject, seed, round(lo, 6) AS late_overlap, (lo > 0.2::DOUBLE)::INT AS y FROM t_placebo")
def placebo_label(spark, sf):
    return placebo(spark, sf).select("subject", "seed", r6(F.col("lo")).alias("late_overlap"), (F.col("lo") > 0.2).cast("int").alias("y"))


cte("t_target", "SELECT field, avg(y::DOUBLE) AS target FROM t_cohort GROUP BY field")


def target(spark, sf):
    return S.cohort(spark, sf).groupBy("field").agg(F.avg("y").alias("target"))


def train_overlaps(spark, sf):
    return placebo(spark, sf).where("split = 'train'").select("field", "seed", "lo")


cte("t_grid", """
SELECT field, seed, theta, rate FROM (SELECT p.field, p.seed, t.i/100.0::DOUBLE AS theta, count(*) FILTER (WHERE lo > t.i/100.0::DOUBLE)::DOUBLE / count(*) AS rate FROM t_placebo p, range(91) t(i) WHERE split = 'train' GROUP BY ALL) x JOIN t_target USING (field)
QUALIFY row_number() OVER (PARTITION BY field, seed ORDER BY abs(rate - target), theta) = 1""")


def calibrate_grid(spark, sf):
    """91 thresholds against counts per distinct overlap, not against rows."""
    v = train_overlaps(spark, sf).groupBy("field", "seed", "lo").agg(n_rows("w"))
    g = v.withColumn("theta", F.explode(F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: i / F.lit(100.0))))
    r = g.groupBy("field", "seed", "theta").agg((F.sum(F.when(F.col("lo") > F.col("theta"), F.col("w")).otherwise(0)).cast("double") / F.sum("w")).alias("rate"))
    return best_theta(r, target(spark, sf), ["field", "seed"])


def best_theta(rates, targets, keys):
    j = rates.join(targets, "field")
    return j.groupBy(*keys).agg(F.min_by(F.struct("theta", "rate"), F.struct(F.abs(F.col("rate") - F.col("target")).alias("d"), "theta")).alias("b")).select(*keys, "b.theta", "b.rate")


@query("theta_calibrate_grid", "SELECT field, seed, theta, round(rate, 6) AS rate FROM t_grid")
def theta_calibrate_grid(spark, sf):
    return calibrate_grid(spark, sf).withColumn("rate", r6(F.col("rate")))


@query("theta_calibrate_atom", """
WITH a AS (SELECT DISTINCT field, seed, lo AS theta FROM t_placebo WHERE split = 'train' UNION SELECT DISTINCT field, seed, 0.0::DOUBLE FROM t_placebo),
r AS (SELECT a.field, a.seed, theta, count(*) FILTER (WHERE p.lo > theta)::DOUBLE / count(*) AS rate FROM a JOIN t_placebo p ON p.field = a.field AND p.seed = a.seed AND split = 'train' GROUP BY ALL)
SELECT field, seed, round(theta, 6) AS theta, round(rate, 6) AS rate FROM r JOIN t_target USING (field) QUALIFY row_number() OVER (PARTITION BY field, seed ORDER BY abs(rate - target), theta) = 1""")
def theta_calibrate_atom(spark, sf):
    """Best threshold among observed values (and 0)."""
    v = train_overlaps(spark, sf)
    atoms = D.rate_above(v, ["field", "seed"], "lo").select("field", "seed", F.col("lo").alias("theta"), F.col("p_gt").alias("rate"))
    zero = v.groupBy("field", "seed").agg((F.count_if(F.col("lo") > 0).cast("double") / F.count(F.lit(1))).alias("rate")).select("field", "seed", F.lit(0.0).alias("theta"), "rate")
    b = best_theta(atoms.unionByName(zero), target(spark, sf), ["field", "seed"])
    return b.select("field", "seed", r6(F.col("theta")).alias("theta"), r6(F.col("rate")).alias("rate"))


cte("t_exact", """
SELECT field, seed, atom, CASE WHEN ok THEN (target - p_gt) / mass ELSE 0 END AS q FROM (
 SELECT field, seed, lo AS atom, p_gt, mass, target, p_gt <= target AND p_ge >= target AS ok FROM (
  SELECT field, seed, lo, (sum(n) OVER w - n)::DOUBLE / sum(n) OVER (PARTITION BY field, seed) AS p_gt, (sum(n) OVER w)::DOUBLE / sum(n) OVER (PARTITION BY field, seed) AS p_ge, n::DOUBLE / sum(n) OVER (PARTITION BY field, seed) AS mass
  FROM (SELECT field, seed, lo, count(*) AS n FROM t_placebo WHERE split = 'train' GROUP BY ALL) z WINDOW w AS (PARTITION BY field, seed ORDER BY lo DESC)) y JOIN t_target USING (field)) x
QUALIFY row_number() OVER (PARTITION BY field, seed ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE abs(p_gt - target) END, atom) = 1""")
cte("t_swap", f"""
SELECT p.*, CASE WHEN lo > atom THEN 1 WHEN lo = atom AND {UNI.format(k="concat_ws('|', p.seed, 'boundary', p.subject)")} < q THEN 1 ELSE 0 END AS y_swap FROM t_placebo p JOIN t_exact e ON e.field = p.field AND e.seed = p.seed""")


def exact_thresholds(spark, sf):
    """The atom whose tail brackets the target and the share q of its own mass to label positive."""
    r = D.rate_above(train_overlaps(spark, sf), ["field", "seed"], "lo").join(target(spark, sf), "field")
    ok = (F.col("p_gt") <= F.col("target")) & (F.col("p_ge") >= F.col("target"))
    dist = F.when(ok, F.lit(0.0)).otherwise(F.abs(F.col("p_gt") - F.col("target")))
    q = F.when(ok, (F.col("target") - F.col("p_gt")) / F.col("mass")).otherwise(F.lit(0.0))
    return r.groupBy("field", "seed").agg(F.min_by(F.struct(F.col("lo").alias("atom"), q.alias("q")), F.struct((~ok).alias("a"), dist.alias("b"), "lo")).alias("m")).select("field", "seed", "m.*")


def swap_labels(spark, sf):
    """Placebo rows with a label at exactly the true base rate on the training rows."""
    def build():
        p = placebo(spark, sf).join(exact_thresholds(spark, sf), ["field", "seed"])
        hit = (F.col("lo") > F.col("atom")) | ((F.col("lo") == F.col("atom")) & (uniform(keyed_md5(F.col("seed"), "boundary", F.col("subject"))) < F.col("q")))
        return p.withColumn("y_swap", hit.cast("int")).drop("atom", "q")
    return S.stage(spark, sf, "swap", build)


@query("theta_calibrate_exact", "SELECT e.field, e.seed, round(atom, 6) AS atom, round(q, 6) AS q, round(r, 6) AS train_rate FROM t_exact e JOIN (SELECT field, seed, avg(y_swap::DOUBLE) AS r FROM t_swap WHERE split = 'train' GROUP BY ALL) s USING (field, seed)")
def theta_calibrate_exact(spark, sf):
    r = swap_labels(spark, sf).where("split = 'train'").groupBy("field", "seed").agg(r6(F.avg("y_swap")).alias("train_rate"))
    return exact_thresholds(spark, sf).select("field", "seed", r6(F.col("atom")).alias("atom"), r6(F.col("q")).alias("q")).join(r, ["field", "seed"])


@query("theta_calibrate_quantile", """
WITH n AS (SELECT field, seed, lo, row_number() OVER (PARTITION BY field, seed ORDER BY lo) - 1 AS i, count(*) OVER (PARTITION BY field, seed) AS n FROM t_placebo WHERE split = 'train'),
p AS (SELECT n.*, (1 - target) * (n - 1) AS pos FROM n JOIN t_target USING (field))
SELECT field, seed, round(max(lo) FILTER (WHERE i = floor(pos)) + (max(lo) FILTER (WHERE i = ceil(pos)) - max(lo) FILTER (WHERE i = floor(pos))) * (max(pos) - floor(max(pos))), 6) AS theta FROM p GROUP BY ALL""")
def theta_calibrate_quantile(spark, sf):
    """theta = quantile(1 - base rate) of the training overlaps; the probability differs per field."""
    c = cumulate(train_overlaps(spark, sf), ["field", "seed"], "lo", {"n": F.lit(1)}, descending=False).join(target(spark, sf), "field")
    pos = (1 - F.col("target")) * (F.col("tot_n") - 1)
    lo, hi, first, last = F.floor(pos), F.ceil(pos), F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    a = c.groupBy("field", "seed").agg(F.max(F.when((first <= lo) & (last >= lo), F.col("lo"))).alias("a"), F.max(F.when((first <= hi) & (last >= hi), F.col("lo"))).alias("b"), F.max(pos - lo).alias("f"))
    return a.select("field", "seed", r6(F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("theta"))


@query("sample_rows", "SELECT field, subject, CAST(rn AS INTEGER) AS draw_rank FROM (SELECT field, subject, row_number() OVER (PARTITION BY field ORDER BY md5(concat_ws('|', 7, 'sample', subject)), subject) AS rn FROM t_cohort) x WHERE rn <= 20")
def sample_rows(spark, sf):
    """Sampling operator: 20 rows per field without replacement."""
    return D.sample_rows(S.cohort(spark, sf).select("field", "subject"), ["field"], "subject", 20, 7)


@query("train_holdout_15", f"""SELECT subject, {UNI.format(k="concat_ws('|', 0, 'holdout', subject)")} < 0.15::DOUBLE AS held_out FROM t_split WHERE split = 'train'""")
def train_holdout_15(spark, sf):
    return S.split(spark, sf).where("split = 'train'").select("subject", (uniform(keyed_md5(0, "holdout", F.col("subject"))) < 0.15).alias("held_out"))


@query("context_subsample", "SELECT field, subject FROM (SELECT field, subject, row_number() OVER (PARTITION BY field ORDER BY md5(concat_ws('|', 3, 'context', subject)), subject) AS rn FROM t_split WHERE split = 'train') x WHERE rn <= 60")
def context_subsample(spark, sf):
    """Sampling operator: a seeded cap on training rows, by two-level rank (a cap may be large)."""
    t = S.split(spark, sf).where("split = 'train'").select("field", "subject").withColumn("_h", keyed_md5(3, "context", F.col("subject")))
    return hash_rank(t, ["field"], "_h", ["subject"], "_rn").where("_rn <= 60").select("field", "subject")


DRAWS = 2000
LANE = "('0x' || substr(md5(concat_ws('|', b, 'boot', subject)), (l * 8 + 1)::BIGINT, 8))::BIGINT"
cte("t_boot", f"""
SELECT field, CAST(b * 4 + l AS INTEGER) AS draw, subject, {' + '.join(f'(h >= {t})::BIGINT' for t in D.POISSON)} AS weight
FROM (SELECT field, subject, b, l, {LANE} AS h FROM t_split, range({DRAWS // 4}) x(b), range(4) y(l) WHERE split = 'test') q WHERE h >= {D.POISSON[0]}""")


@query("bootstrap_index", "SELECT field, draw, subject, weight FROM t_boot")
def bootstrap_index(spark, sf):
    """Weights of the rows in every draw, where a row has any."""
    rows = S.split(spark, sf).where("split = 'test'").select("field", "subject", D.resample_weights(F.col("subject"), DRAWS).alias("w"))
    return rows.select("field", F.posexplode("w").alias("draw", "weight"), "subject").where("weight > 0").select("field", "draw", "subject", F.col("weight").cast("bigint").alias("weight"))


@query("null_random_assignment", """
SELECT CAST(d AS INTEGER) AS draw, a.subject, b.source FROM (SELECT d, subject, row_number() OVER (PARTITION BY d ORDER BY md5(concat_ws('|', d, 'deal', 'to', subject)), subject) AS rn FROM t_cohort, range(100) r(d)) a
JOIN (SELECT d AS e, source, row_number() OVER (PARTITION BY d ORDER BY md5(concat_ws('|', d, 'deal', 'from', subject)), subject) AS rn FROM t_cohort, range(100) r(d)) b ON a.d = b.e AND a.rn = b.rn""")
def null_random_assignment(spark, sf):
    return D.random_assignment_null(S.cohort(spark, sf), "subject", "source", 100)


@query("null_configuration", """
WITH deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM t_pedges UNION ALL SELECT dst FROM t_pedges) x GROUP BY node),
s AS (SELECT node, i, dr, row_number() OVER (PARTITION BY dr ORDER BY md5(concat_ws('|', dr, 'stub', node, i)), node, i) AS rn FROM (SELECT node, unnest(range(1, d + 1)) AS i FROM deg) z, range(100) r(dr))
SELECT DISTINCT CAST(dr AS INTEGER) AS draw, src, dst FROM (SELECT dr, (rn-1)//2 AS p, min(node) AS src, max(node) AS dst, count(*) AS n FROM s GROUP BY ALL) y WHERE n = 2 AND src <> dst""")
def null_configuration(spark, sf):
    return D.configuration_null(pair_graph(spark, sf), 100)
