"""The stage tables of ``stages.py`` said in SQL, for the result check."""

from cohortry.plans.registry import cte

cte("t_ev", """
SELECT o_orderkey AS event_id, o_custkey AS subject,
       CAST(year(o_orderdate)*4 + quarter(o_orderdate) AS INTEGER) AS period,
       o_orderdate AS event_date, CAST(floor(o_totalprice/10000) AS INTEGER) AS cites
FROM orders""")
cte("t_lines", """
SELECT e.event_id, e.subject, e.period, l_partkey AS part, l_suppkey AS source, l_linenumber AS line,
       l_quantity/50 AS score, p_type || '/' || CAST(p_size % 5 AS VARCHAR) AS tag, p_type AS coarse, p_brand AS brand
FROM lineitem JOIN t_ev e ON l_orderkey = e.event_id JOIN part ON l_partkey = p_partkey""")
cte("t_stags", """
SELECT subject, event_id, period, tag, CAST(row_number() OVER (PARTITION BY event_id ORDER BY score DESC, line, part, source) AS INTEGER) AS tag_pos
FROM (SELECT *, row_number() OVER (PARTITION BY event_id, tag ORDER BY score DESC, line, part, source) AS rn
      FROM t_lines WHERE score >= 0.3::DOUBLE) x WHERE rn = 1
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, line, part, source) <= 3""")
cte("t_atags", """
SELECT source, event_id, period, tag, CAST(row_number() OVER (PARTITION BY source, event_id ORDER BY score DESC, line, part) AS INTEGER) AS tag_pos
FROM (SELECT *, row_number() OVER (PARTITION BY source, event_id, tag ORDER BY score DESC, line, part) AS rn
      FROM t_lines WHERE score >= 0.3::DOUBLE) x WHERE rn = 1
QUALIFY row_number() OVER (PARTITION BY source, event_id ORDER BY score DESC, line, part) <= 3""")
cte("t_pair", """
SELECT subject, source, period, count(DISTINCT event_id) AS n_events, min(event_id) AS first_event
FROM t_lines GROUP BY ALL""")
cte("t_sact", "SELECT source, period, count(DISTINCT event_id) AS n_events FROM t_lines GROUP BY ALL")
cte("t_bounds", """
SELECT subject, t0, last_period, CAST(count(*) FILTER (WHERE period <= t0+5) AS INTEGER) AS early_prod,
       CAST(count(*) FILTER (WHERE period > t0+5 AND period <= t0+15) AS INTEGER) AS late_prod
FROM (SELECT subject, period, min(period) OVER (PARTITION BY subject) AS t0, max(period) OVER (PARTITION BY subject) AS last_period FROM t_ev) x
GROUP BY ALL""")
cte("t_stagn", """
SELECT subject, win, tag, count(*) AS n, min(ord) AS ord FROM (
  SELECT t.subject, CASE WHEN t.period <= b.t0+5 THEN 'early' WHEN t.period <= b.t0+15 THEN 'late' END AS win, tag,
         row_number() OVER (PARTITION BY t.subject ORDER BY t.period, event_id, tag_pos) AS ord
  FROM t_stags t JOIN t_bounds b ON t.subject = b.subject) x
WHERE win IS NOT NULL GROUP BY ALL""")
cte("t_sprof", """
SELECT subject, win, list_sort(list(tag) FILTER (WHERE rn <= 10)) AS tags, CAST(count(*) AS INTEGER) AS breadth
FROM (SELECT *, row_number() OVER (PARTITION BY subject, win ORDER BY n DESC, ord) AS rn FROM t_stagn) x GROUP BY ALL""")
cte("t_subj", """
SELECT b.*, coalesce(e.breadth, 0) AS early_breadth, coalesce(l.breadth, 0) AS late_breadth,
       coalesce(e.tags, []) AS early_tags, coalesce(l.tags, []) AS late_tags
FROM t_bounds b LEFT JOIN t_sprof e ON b.subject = e.subject AND e.win = 'early'
LEFT JOIN t_sprof l ON b.subject = l.subject AND l.win = 'late'""")
cte("t_edges", """
SELECT subject, source, min(period) AS first_period, arg_min(first_event, period) AS first_event FROM t_pair GROUP BY ALL""")
cte("t_cuts", "SELECT DISTINCT source, t0+5 AS cut FROM t_edges JOIN t_subj USING (subject)")
cte("t_agn", """
SELECT c.source, c.cut, tag, count(*) AS n, min(ord) AS ord
FROM t_cuts c JOIN (SELECT *, row_number() OVER (PARTITION BY source ORDER BY period, event_id, tag_pos) AS ord FROM t_atags) t
  ON c.source = t.source AND t.period <= c.cut GROUP BY ALL""")
cte("t_aprof", """
SELECT source, cut, list_sort(list(tag) FILTER (WHERE rn <= 10)) AS tags, CAST(count(*) AS INTEGER) AS breadth
FROM (SELECT *, row_number() OVER (PARTITION BY source, cut ORDER BY n DESC, ord) AS rn FROM t_agn) x GROUP BY ALL""")
cte("t_asof", """
SELECT p.source, p.cut, p.prod, p.first_period, coalesce(a.breadth, 0) AS breadth, coalesce(a.tags, []) AS tags
FROM (SELECT c.source, c.cut, CAST(sum(n_events) AS INTEGER) AS prod, min(period) AS first_period
      FROM t_cuts c JOIN t_sact s ON c.source = s.source AND s.period <= c.cut GROUP BY ALL) p
LEFT JOIN t_aprof a ON p.source = a.source AND p.cut = a.cut""")
cte("t_funnel", """
SELECT c_mktsegment AS field, e.subject, e.source, s.t0, s.t0+5 AS cut, s.last_period, s.early_prod, s.late_prod,
       a.prod AS source_prod, sp.source_first, sp.source_last,
       CASE WHEN s.t0 IS NULL THEN 'no_years' WHEN sp.source_first IS NULL THEN 'adv_no_years'
            WHEN s.t0+15 > 8007 THEN 'too_recent' WHEN s.t0 < 7800 THEN 'implausible_t0'
            WHEN s.last_period - s.t0 > 60 OR sp.source_last - sp.source_first > 60 THEN 'span_gt_max'
            WHEN s.early_prod < 3 OR s.late_prod < 3 OR coalesce(a.prod, 0) < 3 THEN 'sparse_windows' END AS drop_reason
FROM t_edges e JOIN customer ON c_custkey = e.subject LEFT JOIN t_subj s ON e.subject = s.subject
LEFT JOIN t_asof a ON e.source = a.source AND a.cut = s.t0+5
LEFT JOIN (SELECT source, min(period) AS source_first, max(period) AS source_last FROM t_sact GROUP BY source) sp ON e.source = sp.source""")
cte("t_cohort", """
SELECT k.field, k.subject, k.source, n_name AS institution, n_regionkey AS region, s.t0, s.early_prod, s.early_breadth,
       a.prod AS source_prod, a.breadth AS source_breadth, CAST(s.t0 - a.first_period AS INTEGER) AS source_age,
       round(CASE WHEN len(early_tags)=0 OR len(a.tags)=0 THEN 0.0::DOUBLE ELSE len(list_intersect(early_tags, a.tags))::DOUBLE/len(list_distinct(early_tags || a.tags)) END, 4) AS early_overlap,
       coalesce(i.n, 0) > 0 AS interacted, CAST(coalesce(i.n, 0) AS INTEGER) AS interaction_n,
       CAST(CASE WHEN len(late_tags)=0 OR len(a.tags)=0 THEN 0.0::DOUBLE ELSE len(list_intersect(late_tags, a.tags))::DOUBLE/len(list_distinct(late_tags || a.tags)) END > 0.2::DOUBLE AS INTEGER) AS y,
       round(CASE WHEN len(late_tags)=0 OR len(a.tags)=0 THEN 0.0::DOUBLE ELSE len(list_intersect(late_tags, a.tags))::DOUBLE/len(list_distinct(late_tags || a.tags)) END, 4) AS late_overlap,
       s.late_prod, early_tags, a.tags AS source_tags, late_tags
FROM (SELECT * FROM t_funnel WHERE drop_reason IS NULL
      QUALIFY row_number() OVER (PARTITION BY subject ORDER BY early_prod DESC, source) = 1) k
JOIN t_subj s ON k.subject = s.subject JOIN t_asof a ON k.source = a.source AND k.cut = a.cut
LEFT JOIN customer ON c_custkey = k.subject LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT p.subject, p.source, sum(n_events) AS n FROM t_pair p JOIN t_bounds b ON p.subject = b.subject
           WHERE p.period BETWEEN b.t0 AND b.t0+5 GROUP BY ALL) i ON i.subject = k.subject AND i.source = k.source""")
cte("t_split", """
SELECT c.*, CASE WHEN t0 <= q1 THEN 'train' WHEN t0 <= q2 THEN 'val' ELSE 'test' END AS split
FROM t_cohort c JOIN (SELECT field, CAST(floor(quantile_cont(t0, 0.6)) AS INTEGER) AS q1, CAST(floor(quantile_cont(t0, 0.8)) AS INTEGER) AS q2
                      FROM t_cohort GROUP BY field) q USING (field)""")
# Ten seeds of three two-column logistic models per field: Newton steps on standardised columns, unrolled. Ten steps
# are more than the fit needs; slopes carry half their square beside the summed loss.
cte("t_lx", """SELECT field, split, subject, source, t0, y, unnest([{'model': 'overlap', 'x1': early_overlap, 'x2': early_breadth::DOUBLE},
 {'model': 'reach', 'x1': source_breadth::DOUBLE, 'x2': source_age::DOUBLE}, {'model': 'volume', 'x1': early_prod::DOUBLE, 'x2': source_prod::DOUBLE}], recursive := true) FROM t_split""")
cte("t_lz", """SELECT t_lx.*, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM t_lx JOIN (SELECT field, model, avg(x1) AS m1, avg(x2) AS m2,
 CASE WHEN stddev_pop(x1) > 1e-12::DOUBLE THEN stddev_pop(x1) ELSE 1 END AS s1, CASE WHEN stddev_pop(x2) > 1e-12::DOUBLE THEN stddev_pop(x2) ELSE 1 END AS s2
 FROM t_lx WHERE split = 'train' GROUP BY field, model) q USING (field, model)""")
cte("t_lt", """SELECT field, model, seed, y, z1, z2 FROM t_lz, range(10) r(seed) WHERE split = 'train'
 AND ('0x' || substr(md5(concat_ws('|', seed, 'holdout', subject)), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.15::DOUBLE""")
cte("t_nb0", "SELECT field, model, seed, count(*) AS n, sum(y)::DOUBLE AS p, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, ln((sum(y) + 0.5::DOUBLE) / (count(*) - sum(y) + 0.5::DOUBLE)) AS b3 FROM t_lt GROUP BY ALL")
NEWTON_STEPS = 10
for _i in range(NEWTON_STEPS):
    cte(f"t_nb{_i + 1}", f"""
WITH d AS (SELECT t.*, b.n, b.p, b1, b2, b3, 1 / (1 + exp(-(b1 * z1 + b2 * z2 + b3))) AS q FROM t_lt t JOIN t_nb{_i} b USING (field, model, seed)),
h AS (SELECT field, model, seed, n, p, b1, b2, b3, sum(z1 * (y - q)) - b1 AS r1, sum(z2 * (y - q)) - b2 AS r2, sum(y - q) AS r3, sum(q * (1 - q) * z1 * z1) + 1 AS a11, sum(q * (1 - q) * z1 * z2) AS a12,
  sum(q * (1 - q) * z1) AS a13, sum(q * (1 - q) * z2 * z2) + 1 AS a22, sum(q * (1 - q) * z2) AS a23, sum(q * (1 - q)) AS a33 FROM d GROUP BY field, model, seed, n, p, b1, b2, b3),
e AS (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM h)
SELECT field, model, seed, n, p, CASE WHEN p > 0 AND p < n THEN b1 + (r1 * (a22 * a33 - a23 * a23) - a12 * (r2 * a33 - a23 * r3) + a13 * (r2 * a23 - a22 * r3)) / det ELSE b1 END AS b1,
 CASE WHEN p > 0 AND p < n THEN b2 + (a11 * (r2 * a33 - a23 * r3) - r1 * (a12 * a33 - a23 * a13) + a13 * (a12 * r3 - r2 * a13)) / det ELSE b2 END AS b2,
 CASE WHEN p > 0 AND p < n THEN b3 + (a11 * (a22 * r3 - r2 * a23) - a12 * (a12 * r3 - r2 * a13) + r1 * (a12 * a23 - a22 * a13)) / det ELSE b3 END AS b3 FROM e""")
cte("t_scores", f"""SELECT field, split, subject, source, t0, model, CAST(seed AS INTEGER) AS seed, y, round(1 / (1 + exp(-(b1 * z1 + b2 * z2 + b3))), 4) AS score
FROM t_lz JOIN t_nb{NEWTON_STEPS} USING (field, model) WHERE split <> 'train'""")
