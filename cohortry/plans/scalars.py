"""Scalar functions over whole tables and whole texts."""

from pyspark.sql import functions as F

from cohortry.functions import numeric as N, textids as X
from cohortry.functions.columns import r6
from cohortry.plans import stages as S
from cohortry.plans.joins import LEV, NAMES_SQL, name_triples
from cohortry.plans.registry import query

RAW_DOI = "CASE page_id % 4 WHEN 0 THEN ' https://doi.org/' || upper(url) WHEN 1 THEN 'http://dx.doi.org/' || url WHEN 2 THEN 'None' ELSE url END"


@query("norm_doi", f"""
SELECT page_id, CASE WHEN d IN ('', 'nan', '0', 'none') THEN '' ELSE replace(replace(replace(replace(d, 'https://doi.org/', ''), 'http://dx.doi.org/', ''), 'http://doi.org/', ''), 'doi.org/', '') END AS doi
FROM (SELECT page_id, lower(trim({RAW_DOI})) AS d FROM pages) x""")
def norm_doi(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.norm_doi(F.expr(RAW_DOI)).alias("doi"))


@query("norm_digits", "SELECT page_id, CASE WHEN d = '0' THEN '' ELSE d END AS digits FROM (SELECT page_id, regexp_replace(url, '[^0-9]', '', 'g') AS d FROM pages) x")
def norm_digits(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.norm_digits(F.col("url")).alias("digits"))


@query("norm_orcid", """
SELECT c_custkey, nullif(regexp_extract(trim(raw), '^(?:https?://orcid\\.org/)?(\\d{4}-\\d{4}-\\d{4}-\\d{3}[\\dX])$', 1), '') AS orcid FROM
(SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'https://orcid.org/' WHEN c_nationkey % 3 = 1 THEN '' ELSE 'id:' END || '0000-0001-' || right('0000' || CAST(c_custkey % 10000 AS VARCHAR), 4) || '-123X ' AS raw FROM customer) x""")
def norm_orcid(spark, sf):
    k = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    prefix = F.when(F.col("c_nationkey") % 3 == 0, "https://orcid.org/").when(F.col("c_nationkey") % 3 == 1, "").otherwise("id:")
    return S.table(spark, sf, "customer").select("c_custkey", X.norm_orcid(F.concat(prefix, F.lit("0000-0001-"), k, F.lit("-123X "))).alias("orcid"))


FOLD_SQL = "trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


@query("norm_name", f"SELECT doc_id, md5(trim(regexp_replace({FOLD_SQL.format(c='text')}, '[^a-z ]', '', 'g'))) AS folded FROM documents")
def norm_name(spark, sf):
    """Folding over whole texts (digest of the result)."""
    return S.table(spark, sf, "documents").select("doc_id", F.md5(X.letters_only(F.col("text"))).alias("folded"))


@query("norm_name_nfkd")
def norm_name_nfkd(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", F.length(X.fold_name_nfkd("text")).alias("n_chars"))


INST = "'University of ' || {a} || ', the ' || {b} || ' College.'"


def inst_raw(a, b):
    return F.concat(F.lit("University of "), F.col(a), F.lit(", the "), F.col(b), F.lit(" College."))


def strip_sql(expr):
    s = FOLD_SQL.format(c=expr)
    for noise in X.INSTITUTION_NOISE:
        s = f"replace({s}, '{noise}', ' ')"
    return f"list_filter(string_split_regex(trim({s}), '\\s+'), lambda t: length(t) > 3)"


@query("inst_tokens", f"SELECT p_partkey, array_to_string(list_sort(list_distinct({strip_sql(INST.format(a='p_name', b='p_type'))})), ';') AS tokens FROM part")
def inst_tokens(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.array_join(F.sort_array(X.inst_tokens(inst_raw("p_name", "p_type"))), ";").alias("tokens"))


@query("token_overlap", f"SELECT p_partkey, len(list_intersect({strip_sql('p_name')}, {strip_sql('p_type')})) > 0 AS shared FROM part")
def token_overlap(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.arrays_overlap(X.inst_tokens(F.col("p_name")), X.inst_tokens(F.col("p_type"))).alias("shared"))


@query("surname_contains", "SELECT p_partkey, contains(lower(p_name), lower(p_type)) AS hit FROM part")
def surname_contains(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.contains(X.fold_name(F.col("p_name")), X.fold_name(F.col("p_type"))).alias("hit"))


@query("initial_match", "SELECT p_partkey, left(lower(p_name), 1) = left(lower(p_type), 1) AS hit FROM part")
def initial_match(spark, sf):
    one = F.lit(1)
    return S.table(spark, sf, "part").select("p_partkey", (F.left(X.fold_name(F.col("p_name")), one) == F.left(X.fold_name(F.col("p_type")), one)).alias("hit"))


@query("name_similarity", f"""
SELECT p_partkey, round(s, 6) AS similarity, CASE WHEN s >= 0.85::DOUBLE THEN 'same' WHEN s < 0.5::DOUBLE THEN 'other' ELSE 'unsure' END AS band
FROM (SELECT p_partkey, {LEV.format(x='b', y='c')} AS s FROM ({NAMES_SQL}) n) x""")
def name_similarity(spark, sf):
    s = X.edit_similarity(F.col("b"), F.col("c"))
    return name_triples(spark, sf).select("p_partkey", r6(s).alias("similarity"), F.when(s >= 0.85, "same").when(s < 0.5, "other").otherwise("unsure").alias("band"))


@query("name_similarity_blocks")
def name_similarity_blocks(spark, sf):
    return name_triples(spark, sf).select("p_partkey", r6(X.block_similarity("b", "c")).alias("similarity"))


def inverted(spark, sf):
    """(doc_id, index): entries (token, positions) of a whole text, inside its row: (token, position) pairs are
    sorted and each run of one token becomes an entry."""
    at = F.array_sort(F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("token"), i.alias("pos"))))
    rows = S.table(spark, sf, "documents").select("doc_id", at.alias("at"))
    starts = F.filter(F.transform("at", lambda x, i: F.when((i == 0) | (F.get("at", i - 1)["token"] != x["token"]), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "at", F.concat(starts, F.array(F.size("at"))).alias("cut"))
    entry = F.transform(F.slice("cut", F.lit(1), F.size("cut") - 1), lambda s, k: F.struct(
        F.get("at", s)["token"].alias("token"), F.transform(F.slice("at", s + 1, F.get("cut", k + 1) - s), lambda x: x["pos"]).alias("positions")))
    return rows.select("doc_id", entry.alias("index"))


@query("text_to_inverted_index", """
SELECT doc_id, count(*) AS n_tokens, md5(string_agg(e, '|' ORDER BY e)) AS digest FROM (
 SELECT doc_id, token || ':' || string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS e FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents) x GROUP BY doc_id, token) y GROUP BY doc_id""")
def text_to_inverted_index(spark, sf):
    e = F.transform("index", lambda x: F.concat(x["token"], F.lit(":"), F.array_join(F.transform(x["positions"], lambda p: p.cast("string")), ",")))
    return inverted(spark, sf).select("doc_id", F.size("index").cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.sort_array(e), "|")).alias("digest"))


@query("inverted_index_to_text", "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents")
def inverted_index_to_text(spark, sf):
    """Index map back to the text: entries -> (position, word) pairs -> sorted -> joined."""
    index = inverted(spark, sf).select("doc_id", F.map_from_entries("index").alias("index"))
    pairs = F.flatten(F.transform(F.map_entries("index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    return index.select("doc_id", text.alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("token_join_underscore", "SELECT subject, array_to_string(list_transform(early_tags, lambda t: replace(replace(t, ' ', '_'), '/', '_')), ' ') AS doc FROM t_cohort")
def token_join_underscore(spark, sf):
    doc = F.array_join(F.transform("early_tags", lambda t: F.translate(t, " /", "__")), " ")
    return S.cohort(spark, sf).select("subject", doc.alias("doc"))


@query("cohort_bin", "SELECT subject, CAST(t0//5*5 AS INTEGER) AS bin5, CAST(t0//10*10 AS INTEGER) AS bin10 FROM t_cohort")
def cohort_bin(spark, sf):
    return S.cohort(spark, sf).selectExpr("subject", "cast(t0 div 5 * 5 as int) as bin5", "cast(t0 div 10 * 10 as int) as bin10")


@query("zscore", """
SELECT subject, round((early_prod - m) / s, 6) AS z_all, round((early_prod - mr) / sr, 6) AS z_train FROM t_split JOIN
(SELECT field, avg(early_prod::DOUBLE) AS m, stddev_samp(early_prod::DOUBLE) AS s, avg(early_prod::DOUBLE) FILTER (WHERE split = 'train') AS mr, stddev_samp(early_prod::DOUBLE) FILTER (WHERE split = 'train') AS sr FROM t_split GROUP BY field) q USING (field)""")
def zscore(spark, sf):
    """Standardised over all rows and over the reference block (training rows) only."""
    c = S.split(spark, sf)
    x, tr = F.col("early_prod").cast("double"), F.when(F.col("split") == "train", F.col("early_prod").cast("double"))
    q = c.groupBy("field").agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.avg(tr).alias("mr"), F.stddev_samp(tr).alias("sr"))
    return c.join(q, "field").select("subject", r6((x - F.col("m")) / F.col("s")).alias("z_all"), r6((x - F.col("mr")) / F.col("sr")).alias("z_train"))


@query("round4", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / 7, 4) AS v FROM lineitem")
def round4(spark, sf):
    return S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 F.round(F.col("l_quantity") / 7, 4).alias("v"))


@query("cosine_divergence", """
SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS divergence FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_divergence(spark, sf):
    """Each vector against its successor."""
    e = S.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", r6(N.cosine_divergence(F.col("embedding"), F.col("other"))).alias("divergence"))


@query("wilson_interval", """
SELECT field, n, round((p + 3.8416::DOUBLE/(2*n))/(1+3.8416::DOUBLE/n) - 1.96::DOUBLE*sqrt(p*(1-p)/n + 3.8416::DOUBLE/(4*n*n))/(1+3.8416::DOUBLE/n), 6) AS lo,
 round((p + 3.8416::DOUBLE/(2*n))/(1+3.8416::DOUBLE/n) + 1.96::DOUBLE*sqrt(p*(1-p)/n + 3.8416::DOUBLE/(4*n*n))/(1+3.8416::DOUBLE/n), 6) AS hi
FROM (SELECT field, count(*) AS n, avg(y::DOUBLE) AS p FROM t_cohort GROUP BY field) x""")
def wilson_interval(spark, sf):
    g = S.cohort(spark, sf).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("p"))
    lo, hi = N.wilson(F.col("p"), F.col("n"))
    return g.select("field", "n", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query("tost_equivalence", f"""
SELECT field, round(pl, 5) AS p_lower, round(pu, 5) AS p_upper, round(greatest(pl, pu), 5) AS p_tost, round(c - 1.645::DOUBLE*se, 6) AS lo90, round(c + 1.645::DOUBLE*se, 6) AS hi90,
 (c - 1.645::DOUBLE*se > -0.05::DOUBLE) AND (c + 1.645::DOUBLE*se < 0.05::DOUBLE) AS equivalent
FROM (SELECT *, 1 - {N.normal_cdf_sql('((c + 0.05::DOUBLE)/se)')} AS pl, {N.normal_cdf_sql('((c - 0.05::DOUBLE)/se)')} AS pu FROM
 (SELECT field, avg(late_overlap - early_overlap) AS c, stddev_samp(late_overlap - early_overlap)/sqrt(count(*)) AS se FROM t_cohort GROUP BY field) x) y""")
def tost_equivalence(spark, sf):
    d = F.col("late_overlap") - F.col("early_overlap")
    g = S.cohort(spark, sf).groupBy("field").agg(F.avg(d).alias("c"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    t = N.tost(F.col("c"), F.col("se"), 0.05)
    return g.select("field", *[F.round(t[k], 5).alias(k) for k in ("p_lower", "p_upper", "p_tost")], r6(t["lo90"]).alias("lo90"), r6(t["hi90"]).alias("hi90"), t["equivalent"].alias("equivalent"))


@query("mde_power", """
SELECT field, round(s, 6) AS sigma, round(2.8::DOUBLE*s, 6) AS mde, round(c - 1.645::DOUBLE*s, 6) AS lo90, round(c + 1.645::DOUBLE*s, 6) AS hi90, eq_at AS equivalent_at,
 CASE WHEN lo > 0 THEN 'exceeds' WHEN eq_at IS NOT NULL THEN 'equivalent' ELSE 'not identifiable' END AS verdict
FROM (SELECT *, CASE WHEN c - 1.645::DOUBLE*s > -0.01::DOUBLE AND c + 1.645::DOUBLE*s < 0.01::DOUBLE THEN 0.01::DOUBLE WHEN c - 1.645::DOUBLE*s > -0.02::DOUBLE AND c + 1.645::DOUBLE*s < 0.02::DOUBLE THEN 0.02::DOUBLE
 WHEN c - 1.645::DOUBLE*s > -0.03::DOUBLE AND c + 1.645::DOUBLE*s < 0.03::DOUBLE THEN 0.03::DOUBLE END AS eq_at FROM (SELECT *, ((c + 1.96::DOUBLE*se) - (c - 1.96::DOUBLE*se))/3.92::DOUBLE AS s, c - 1.96::DOUBLE*se AS lo FROM
 (SELECT field, avg(late_overlap - early_overlap) AS c, stddev_samp(late_overlap - early_overlap)/sqrt(count(*)) AS se FROM t_cohort GROUP BY field) x) y) z""")
def mde_power(spark, sf):
    d = F.col("late_overlap") - F.col("early_overlap")
    g = S.cohort(spark, sf).groupBy("field").agg(F.avg(d).alias("c"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"))
    lo, hi = F.col("c") - 1.96 * F.col("se"), F.col("c") + 1.96 * F.col("se")
    p = N.power(F.col("c"), lo, hi, lo > 0)
    return g.select("field", *[r6(p[k]).alias(k) for k in ("sigma", "mde", "lo90", "hi90")], p["equivalent_at"].alias("equivalent_at"), p["verdict"].alias("verdict"))


@query("json_props", "SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS k_sum, min(CAST(props->>'$.k' AS INTEGER)) AS k_min FROM events GROUP BY event_type")
def json_props(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return S.table(spark, sf, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.min("k").alias("k_min"))
