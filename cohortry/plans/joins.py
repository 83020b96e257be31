"""Joins: enrichment, resolution, as-of, peers, lineage, outcomes."""

from pyspark.sql import functions as F

from cohortry.functions import textids as X
from cohortry.functions.columns import r6, render
from cohortry.operators import impact, lineage as L, peers, profiles, resolve as V
from cohortry.operators.ordering import first_by
from cohortry.plans import stages as S
from cohortry.plans.ingest import link_rows
from cohortry.plans.registry import cte, query

JAC = "CASE WHEN len({a})=0 OR len({b})=0 THEN 0.0::DOUBLE ELSE len(list_intersect({a},{b}))::DOUBLE/len(list_distinct({a} || {b})) END"


def jac(a, b):
    return JAC.format(a=a, b=b)


@query("edge_enrich", """
SELECT CAST(e.subject AS VARCHAR) || '-' || CAST(e.source AS VARCHAR) AS connection_id, first_event, c_name AS stu_name, cn.n_name AS stu_nation,
       s_name AS adv_name, sn.n_name AS adv_nation
FROM (SELECT subject, source, min(event_id) AS first_event FROM t_lines GROUP BY ALL) e
LEFT JOIN customer ON c_custkey = e.subject LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey
LEFT JOIN supplier ON s_suppkey = e.source LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey""")
def edge_enrich(spark, sf):
    """Edge rows with both persons' columns; a repeated edge keeps its first row."""
    raw = S.lines(spark, sf).select(F.concat_ws("-", "subject", "source").alias("connection_id"), "subject", "source", "event_id")
    edges = first_by(raw, ["connection_id"], [F.col("event_id"), F.col("subject")], ["subject", "source", F.col("event_id").alias("first_event")])
    n = S.table(spark, sf, "nation").select("n_nationkey", "n_name")

    def person(table, key, name, nation, role):
        return (S.table(spark, sf, table).select(F.col(key).alias("subject" if role == "stu" else "source"), F.col(name).alias(f"{role}_name"),
                                                 F.col(nation).alias("n_nationkey"))
                .join(n, "n_nationkey", "left").withColumnRenamed("n_name", f"{role}_nation").drop("n_nationkey"))
    return (edges.join(person("customer", "c_custkey", "c_name", "c_nationkey", "stu"), "subject", "left")
            .join(person("supplier", "s_suppkey", "s_name", "s_nationkey", "adv"), "source", "left")
            .select("connection_id", "first_event", "stu_name", "stu_nation", "adv_name", "adv_nation"))


@query("person_union_distinct", """
SELECT pid, role, first_event FROM (SELECT source AS pid, 0 AS role, * FROM t_edges UNION ALL BY NAME SELECT subject AS pid, 1 AS role, * FROM t_edges) x
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY first_period, first_event, subject, source, role) = 1""")
def person_union_distinct(spark, sf):
    """Everyone seen in either role; the first record in (edge, role) order wins."""
    e = S.edges(spark, sf)
    both = e.select("*", F.col("source").alias("pid"), F.lit(0).alias("role")).unionByName(
        e.select("*", F.col("subject").alias("pid"), F.lit(1).alias("role")))
    order = [F.col(c) for c in ("first_period", "first_event", "subject", "source", "role")]
    return first_by(both, ["pid"], order, ["role", "first_event"])


@query("semi_keep_persons", """
SELECT CAST(subject AS VARCHAR) AS pid, CAST(event_id AS VARCHAR) AS pubid, round(cites/50.0::DOUBLE, 6) AS score_total FROM t_ev
WHERE cites/50.0::DOUBLE >= 0.3::DOUBLE AND subject IN (SELECT subject FROM t_cohort)""")
def semi_keep_persons(spark, sf):
    wanted = S.cohort(spark, sf).select(F.col("subject").cast("string").alias("pid"))
    return (link_rows(spark, sf).where(F.col("score_total") >= 0.3).join(wanted, "pid", "left_semi")
            .select("pid", "pubid", r6(F.col("score_total")).alias("score_total")))


cte("t_anchor", """
SELECT CAST(subject AS VARCHAR) AS pid, CAST(event_id AS VARCHAR) AS pubid, '10.1/' || CAST(event_id AS VARCHAR) AS doi,
       CASE WHEN cites % 3 > 0 AND event_id <> 0 THEN CAST(event_id AS VARCHAR) ELSE '' END AS pmid
FROM t_ev WHERE cites/50.0::DOUBLE >= 0.3::DOUBLE
QUALIFY row_number() OVER (PARTITION BY subject ORDER BY cites DESC, CAST(event_id AS VARCHAR)) <= 25""")
cte("t_akeys", """
SELECT DISTINCT pid, pubid, k FROM (SELECT pid, pubid, 'doi:' || doi AS k FROM t_anchor UNION ALL SELECT pid, pubid, 'pmid:' || pmid FROM t_anchor WHERE pmid <> '') x""")
cte("t_tally", """
SELECT pid, aid, count(*) AS hits, count(DISTINCT pubid) AS works FROM (
  SELECT a.pid, a.pubid, a.k, l.source AS aid FROM t_akeys a JOIN (SELECT DISTINCT event_id, source FROM t_lines) l ON a.pubid = CAST(l.event_id AS VARCHAR)
  WHERE contains(right('0' || CAST(l.source AS VARCHAR), 2), right(a.pid, 1))) x GROUP BY ALL""")
cte("t_resolved", """
SELECT CAST(c_custkey AS VARCHAR) AS pid, CASE WHEN ok THEN aid END AS aid, CASE WHEN ok THEN 'pubid' ELSE 'pubid_nohit' END AS method,
       CASE WHEN ok THEN hits ELSE 0 END AS hits
FROM customer LEFT JOIN (SELECT pid, arg_min(aid, (-hits * 1000000000 + aid)) AS aid, max(hits) AS hits, (max(hits) >= 2 OR count(*) = 1) AS ok FROM t_tally GROUP BY pid) t
  ON t.pid = CAST(c_custkey AS VARCHAR)""")


def anchor_rows(spark, sf):
    return V.anchors(link_rows(spark, sf), 0.3, 25)


def work_authors(spark, sf):
    """Author lists of works under both kinds of work key. A supplier's short name is its last two digits."""
    s = S.lines(spark, sf).select("event_id", "source").distinct()
    name = F.substring(F.lpad(F.col("source").cast("string"), 12, "0"), 11, 2)
    k = F.col("event_id").cast("string")
    keys = F.explode(F.array(F.concat(F.lit("doi:10.1/"), k), F.concat(F.lit("pmid:"), k)))
    return s.select(keys.alias("k"), F.col("source").alias("aid"), name.alias("name"))


def anchor_persons(spark, sf):
    """Surname of a customer = last digit of its key."""
    c = S.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("pid"), F.substring(F.col("c_custkey").cast("string"), -1, 1).alias("lastname"))


def resolved(spark, sf, dedupe=False):
    return V.resolve_by_anchor(V.anchor_keys(anchor_rows(spark, sf)), work_authors(spark, sf), anchor_persons(spark, sf), 2, dedupe)


@query("anchor_topn", """
SELECT pid, array_to_string(list_sort(list(DISTINCT doi)), ';') AS dois, coalesce(array_to_string(list_sort(list(DISTINCT pmid) FILTER (WHERE pmid <> '')), ';'), '') AS pmids
FROM t_anchor GROUP BY pid""")
def anchor_topn(spark, sf):
    """Each list holds at most the top-n anchors of one person."""
    def joined(c):
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ";")
    return anchor_rows(spark, sf).groupBy("pid").agg(joined("doi").alias("dois"), joined("pmid").alias("pmids"))


@query("resolve_by_anchor", "SELECT pid, aid, method, hits FROM t_resolved")
def resolve_by_anchor(spark, sf):
    return resolved(spark, sf)


@query("resolve_by_anchor_per_work", """
SELECT CAST(c_custkey AS VARCHAR) AS pid, CASE WHEN ok THEN aid END AS aid, CASE WHEN ok THEN 'pubid' ELSE 'pubid_nohit' END AS method,
       CASE WHEN ok THEN works ELSE 0 END AS hits
FROM customer LEFT JOIN (SELECT pid, arg_min(aid, (-works * 1000000000 + aid)) AS aid, max(works) AS works, (max(works) >= 2 OR count(*) = 1) AS ok FROM t_tally GROUP BY pid) t
  ON t.pid = CAST(c_custkey AS VARCHAR)""")
def resolve_by_anchor_per_work(spark, sf):
    """The option that lets a work speak once even when both its ids match."""
    return resolved(spark, sf, dedupe=True)


@query("resolve_by_features", """
WITH c AS (SELECT e.subject AS pid, e.source AS aid, e.subject = e.source AS orcid_hit,
   contains(right('0' || CAST(e.source AS VARCHAR), 2), right(CAST(e.subject AS VARCHAR), 1)) AS lastname,
   left(CAST(e.source AS VARCHAR), 1) = left(CAST(e.subject AS VARCHAR), 1) AS firstinit, c_nationkey = s_nationkey AS inst,
   cn.n_regionkey = sn.n_regionkey AS field, coalesce(w.n, 0) BETWEEN 3 AND 2000 AS works_ok
 FROM t_edges e JOIN customer ON c_custkey = e.subject JOIN nation cn ON cn.n_nationkey = c_nationkey
 JOIN supplier ON s_suppkey = e.source JOIN nation sn ON sn.n_nationkey = s_nationkey
 LEFT JOIN (SELECT source, sum(n_events) AS n FROM t_sact GROUP BY source) w ON w.source = e.source),
s AS (SELECT *, CASE WHEN orcid_hit THEN 99.0::DOUBLE ELSE 2.0::DOUBLE*lastname::INT + 0.5::DOUBLE*firstinit::INT + 2.0::DOUBLE*inst::INT + 1.5::DOUBLE*field::INT + 0.5::DOUBLE*works_ok::INT END AS s FROM c)
SELECT pid, CASE WHEN s >= 3.0::DOUBLE THEN aid END AS aid, CASE WHEN orcid_hit THEN 'orcid' WHEN s >= 3.0::DOUBLE THEN 'name' ELSE 'below_threshold' END AS method, round(s, 3) AS confidence
FROM s QUALIFY row_number() OVER (PARTITION BY pid ORDER BY s DESC, aid) = 1""")
def resolve_by_features(spark, sf):
    """Candidates of a person are the sources met on its events (linear in the edges)."""
    n = S.table(spark, sf, "nation")
    subj = (S.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("subject"), F.col("n_nationkey").alias("cn"), F.col("n_regionkey").alias("cr")))
    src = (S.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
           .select(F.col("s_suppkey").alias("source"), F.col("n_nationkey").alias("sn"), F.col("n_regionkey").alias("sr")))
    works = S.source_activity(spark, sf).groupBy("source").agg(F.sum("n_events").alias("works"))
    a, p = F.col("source").cast("string"), F.col("subject").cast("string")
    cands = S.edges(spark, sf).join(subj, "subject").join(src, "source").join(works, "source", "left").select(
        F.col("subject").alias("pid"), F.col("source").alias("aid"), (F.col("subject") == F.col("source")).alias("orcid_hit"),
        F.contains(F.substring(F.lpad(a, 12, "0"), 11, 2), F.substring(p, -1, 1)).alias("lastname"),
        (F.left(a, F.lit(1)) == F.left(p, F.lit(1))).alias("firstinit"), (F.col("cn") == F.col("sn")).alias("inst"),
        (F.col("cr") == F.col("sr")).alias("field"), F.coalesce("works", F.lit(0)).between(3, 2000).alias("works_ok"))
    return V.resolve_by_features(cands)


@query("resolution_apply", """
SELECT count(*) AS n_edges, round(avg((a.aid IS NOT NULL)::INT::DOUBLE), 6) AS source_coverage, round(avg((s.aid IS NOT NULL)::INT::DOUBLE), 6) AS subject_coverage,
       coalesce(sum(s.hits), 0)::BIGINT AS subject_hits
FROM t_edges e LEFT JOIN t_resolved a ON a.pid = CAST(e.source AS VARCHAR) LEFT JOIN t_resolved s ON s.pid = CAST(e.subject AS VARCHAR)""")
def resolution_apply(spark, sf):
    e = S.edges(spark, sf).select(F.col("subject").cast("string").alias("subject"), F.col("source").cast("string").alias("source"))
    out = V.apply_resolution(e, resolved(spark, sf))
    return out.agg(F.count(F.lit(1)).alias("n_edges"), r6(F.avg(F.col("source_aid").isNotNull().cast("int"))).alias("source_coverage"),
                   r6(F.avg(F.col("subject_aid").isNotNull().cast("int"))).alias("subject_coverage"),
                   F.coalesce(F.sum("subject_hits"), F.lit(0)).alias("subject_hits"))


cte("t_truth", """
SELECT CAST(subject AS VARCHAR) AS pid, arg_min(source, (-n * 1000000000 + source)) AS truth FROM
(SELECT subject, source, sum(n_events)::BIGINT AS n FROM t_pair GROUP BY ALL) x GROUP BY subject""")


@query("resolution_validate", """
SELECT count(*) AS evaluated, count(aid) AS got, count(*) FILTER (WHERE aid = truth) AS correct,
       round(count(aid)::DOUBLE / greatest(count(*), 1), 6) AS coverage, round(count(*) FILTER (WHERE aid = truth)::DOUBLE / greatest(count(aid), 1), 6) AS precision
FROM t_truth LEFT JOIN t_resolved USING (pid)""")
def resolution_validate(spark, sf):
    """Truth here: the source with most joint events."""
    n = S.pair_activity(spark, sf).groupBy("subject", "source").agg(F.sum("n_events").alias("n"))
    truth = first_by(n, ["subject"], [-F.col("n"), F.col("source")], [F.col("source").alias("truth")]).select(
        F.col("subject").cast("string").alias("pid"), "truth")
    j = truth.join(resolved(spark, sf), "pid", "left")
    got, ok, one = F.count("aid"), F.count_if(F.col("aid") == F.col("truth")), F.lit(1)
    return j.agg(F.count(one).alias("evaluated"), got.alias("got"), ok.alias("correct"),
                 r6(got / F.greatest(F.count(one), one)).alias("coverage"), r6(ok / F.greatest(got, one)).alias("precision"))


@query("orcid_agreement", """
WITH p AS (SELECT DISTINCT e.source AS aid, c_nationkey AS orcid FROM t_cohort e JOIN customer ON c_custkey = subject),
a AS (SELECT s_suppkey AS aid, CASE WHEN n_regionkey <> 4 THEN s_nationkey END AS orcid FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 1000)
SELECT CASE WHEN a.aid IS NULL THEN 'missing' WHEN a.orcid IS NULL THEN 'no_link' WHEN a.orcid = p.orcid THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n
FROM p LEFT JOIN a ON p.aid = a.aid GROUP BY ALL""")
def orcid_agreement(spark, sf):
    """One audit row per unique (author, recorded id); the author record may lack the id or be missing."""
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("orcid"))
    pairs = S.cohort(spark, sf).join(c, "subject").select(F.col("source").alias("aid"), "orcid").distinct()
    return id_outcomes(pairs, author_records(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def author_records(spark, sf):
    n = S.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return (S.table(spark, sf, "supplier").where(F.col("s_acctbal") >= 1000).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("aid"), F.when(F.col("n_regionkey") != 4, F.col("s_nationkey")).alias("held"), F.lit(1).alias("known")))


def id_outcomes(pairs, authors):
    out = (F.when(F.col("known").isNull(), "missing").when(F.col("held").isNull(), "no_link")
           .when(F.col("held") == F.col("orcid"), "agree").otherwise("disagree"))
    return pairs.join(authors, "aid", "left").withColumn("outcome", out)


NAMES_SQL = """
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z ]', '', 'g') AS a, regexp_replace(lower(p_type), '[^a-z ]', '', 'g') AS b,
       regexp_replace(lower(p_name), '[^a-z ]', '', 'g') || CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 's' ELSE ' holding' END AS c FROM part"""


def name_triples(spark, sf):
    """Holder, resolved and recorded spellings of a name."""
    a, b = X.letters_only(F.col("p_name")), X.letters_only(F.col("p_type"))
    tail = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "s").otherwise(" holding")
    return S.table(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"), F.concat(a, tail).alias("c"))


LEV = "CASE WHEN length({x})=0 OR length({y})=0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({x},{y})::DOUBLE/greatest(length({x}),length({y})) END"


@query("disagreement_classify", f"""
SELECT class, count(*) AS n FROM (SELECT CASE WHEN s_res >= 0.85::DOUBLE THEN 'id_split' WHEN s_rec >= 0.85::DOUBLE THEN 'resolver_error'
   WHEN s_rec < 0.5::DOUBLE AND s_res < 0.5::DOUBLE THEN 'original_id_error' ELSE 'human_ambiguous' END AS class
 FROM (SELECT {LEV.format(x='a', y='c')} AS s_res, {LEV.format(x='a', y='b')} AS s_rec FROM ({NAMES_SQL}) n) x) y GROUP BY class""")
def disagreement_classify(spark, sf):
    t = name_triples(spark, sf)
    cls = V.classify_disagreement(X.edit_similarity(F.col("a"), F.col("c")), X.edit_similarity(F.col("a"), F.col("b")))
    return t.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("disagreement_classify_blocks")
def disagreement_classify_blocks(spark, sf):
    """The same rule on the matching-block ratio (Arrow batches)."""
    t = name_triples(spark, sf).select(X.block_similarity("a", "c").alias("r"), X.block_similarity("a", "b").alias("o"))
    return t.groupBy(V.classify_disagreement(F.col("r"), F.col("o")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("asof_profile_join", """
SELECT f.subject, f.source, a.prod, a.breadth, a.first_period, array_to_string(a.tags, '; ') AS tags
FROM t_funnel f JOIN t_asof a ON a.source = f.source AND a.cut = f.cut WHERE f.drop_reason IS NULL""")
def asof_profile_join(spark, sf):
    """Each surviving edge with its source's profile as of t0+5."""
    e = S.funnel(spark, sf).where(F.col("drop_reason").isNull()).select("subject", "source", "cut")
    return e.join(S.source_asof(spark, sf), ["source", "cut"]).select("subject", "source", "prod", "breadth", "first_period", render(F.col("tags")).alias("tags"))


@query("pair_history_join", """
WITH s AS (SELECT DISTINCT subject AS id FROM t_stags), a AS (SELECT DISTINCT source AS id FROM t_atags)
SELECT subject, source FROM t_edges WHERE subject IN (SELECT id FROM s) AND source IN (SELECT id FROM a)""")
def pair_history_join(spark, sf):
    s = S.subject_tags(spark, sf).select("subject")
    a = S.source_tags(spark, sf).select("source")
    return S.edges(spark, sf).select("subject", "source").join(s, "subject", "left_semi").join(a, "source", "left_semi")


@query("peer_prior_join", """
SELECT i.subject, count(j.subject) AS n_prior, round(coalesce(sum(j.early_overlap), 0), 6) AS overlap_sum FROM t_cohort i
LEFT JOIN t_cohort j ON j.source = i.source AND j.t0 <= i.t0 AND j.subject <> i.subject GROUP BY i.subject""")
def peer_prior_join(spark, sf):
    c = S.cohort(spark, sf).select("subject", "source", "t0", "early_overlap")
    p = peers.peer_sums(c, ["source"], "t0", ["early_overlap"], 0, "p_")
    return p.select("subject", (F.col("p_n") - 1).alias("n_prior"), r6(F.col("p_early_overlap").cast("double") - F.col("early_overlap")).alias("overlap_sum"))


@query("peer_closed_join", """
SELECT i.subject, count(j.subject) AS n_closed, coalesce(sum(j.y), 0)::DOUBLE AS y_sum FROM t_cohort i
LEFT JOIN t_cohort j ON j.source = i.source AND j.t0 + 10 <= i.t0 AND j.subject <> i.subject GROUP BY i.subject""")
def peer_closed_join(spark, sf):
    c = S.cohort(spark, sf).select("subject", "source", "t0", "y")
    return peers.peer_sums(c, ["source"], "t0", ["y"], -10, "c_").select("subject", F.col("c_n").alias("n_closed"), F.col("c_y").cast("double").alias("y_sum"))


@query("sibling_edges", """
SELECT j.source, j.t0 AS t_from, i.t0 AS t_to, count(DISTINCT j.subject) AS n_from, count(DISTINCT i.subject) AS n_to, count(*) FILTER (WHERE i.subject <> j.subject) AS n_edges
FROM t_cohort i JOIN t_cohort j ON i.source = j.source AND j.t0 <= i.t0 GROUP BY ALL HAVING count(*) FILTER (WHERE i.subject <> j.subject) > 0""")
def sibling_edges(spark, sf):
    return peers.sibling_blocks(S.cohort(spark, sf))


@query("sibling_edges_all_cohorts", """
SELECT j.source, j.t0 AS t_from, i.t0 AS t_to, count(DISTINCT j.subject) AS n_from, count(DISTINCT i.subject) AS n_to, count(*) FILTER (WHERE i.subject <> j.subject) AS n_edges
FROM t_cohort i JOIN t_cohort j ON i.source = j.source GROUP BY ALL HAVING count(*) FILTER (WHERE i.subject <> j.subject) > 0""")
def sibling_edges_all_cohorts(spark, sf):
    return peers.sibling_blocks(S.cohort(spark, sf), prior_only=False)


@query("cohort_band_join", """
SELECT i.subject, count(j.subject) AS pool_size FROM t_cohort i LEFT JOIN t_cohort j ON abs(j.t0 - i.t0) <= 3 AND j.source <> i.source GROUP BY i.subject""")
def cohort_band_join(spark, sf):
    return peers.band_counts(S.cohort(spark, sf).select("subject", "source", "t0"), [], "source", "t0", 3).select("subject", "pool_size")


cte("t_parent", "SELECT subject AS pid, source AS parent FROM t_edges QUALIFY row_number() OVER (PARTITION BY subject ORDER BY first_period, first_event, source) = 1")


def parents(spark, sf):
    return L.parent_map(S.edges(spark, sf))


@query("two_hop_lineage", "SELECT c.subject, c.source, p.parent AS grand FROM t_cohort c LEFT JOIN t_parent p ON p.pid = c.source")
def two_hop_lineage(spark, sf):
    return L.two_hop(S.cohort(spark, sf).select("subject", "source"), parents(spark, sf))


@query("lineage_depth", """
WITH RECURSIVE walk AS (
  SELECT pid AS start, pid AS cur, 0 AS d, []::BIGINT[] AS seen FROM t_parent
  UNION ALL
  SELECT w.start, p.parent, w.d + 1, list_append(w.seen, w.cur) FROM walk w JOIN t_parent p ON p.pid = w.cur
  WHERE NOT list_contains(w.seen, w.cur) AND w.d < 12)
SELECT start AS pid, CAST(max(d) AS INTEGER) AS depth FROM walk GROUP BY start""")
def lineage_depth(spark, sf):
    return L.lineage_depth(L.ancestor_paths(parents(spark, sf)))


cte("t_gcut", "SELECT c.*, c.t0 + 5 AS cut, p.parent AS grand FROM t_cohort c LEFT JOIN t_parent p ON p.pid = c.source")
cte("t_gprof", """
SELECT grand AS source, cut, list_sort(list(tag) FILTER (WHERE rn <= 10)) AS tags, CAST(count(*) AS INTEGER) AS breadth FROM (
 SELECT grand, cut, tag, row_number() OVER (PARTITION BY grand, cut ORDER BY n DESC, tag) AS rn FROM (
  SELECT g.grand, g.cut, tag, count(*) AS n FROM (SELECT DISTINCT grand, cut FROM t_gcut WHERE grand IS NOT NULL) g JOIN t_atags t ON t.source = g.grand AND t.period <= g.cut GROUP BY ALL) x) y GROUP BY ALL""")
cte("t_gasof", """
SELECT p.*, coalesce(a.breadth, 0) AS breadth, coalesce(a.tags, []) AS tags FROM (
 SELECT g.grand AS source, g.cut, CAST(sum(n_events) AS INTEGER) AS prod, min(period) AS first_period
 FROM (SELECT DISTINCT grand, cut FROM t_gcut WHERE grand IS NOT NULL) g JOIN t_sact s ON s.source = g.grand AND s.period <= g.cut GROUP BY ALL) p
LEFT JOIN t_gprof a ON a.source = p.source AND a.cut = p.cut""")
cte("t_lineage", f"""
SELECT c.field, c.subject, c.source, c.grand, c.t0, c.y, c.early_overlap, coalesce(g.prod, 0) AS grand_prod, coalesce(g.breadth, 0) AS grand_breadth,
       CAST(greatest(coalesce(c.t0 - g.first_period, 0), 0) AS INTEGER) AS grand_age, coalesce(g.tags, []) AS grand_tags,
       coalesce({jac('c.early_tags', 'g.tags')}, 0) AS jac_subject_grand, coalesce({jac('c.source_tags', 'g.tags')}, 0) AS jac_source_grand,
       CAST(coalesce(g.prod, 0) > 0 AS INTEGER) AS has_grand
FROM t_gcut c LEFT JOIN t_gasof g ON g.source = c.grand AND g.cut = c.cut""")


def lineage(spark, sf):
    def build():
        rows = L.two_hop(S.cohort(spark, sf), parents(spark, sf)).withColumn("cut", F.col("t0") + S.SPEC.windows.early)
        cuts = rows.where(F.col("grand").isNotNull()).select(F.col("grand").alias("source"), "cut").distinct()
        asof = profiles.asof_profiles(profiles.history_steps(S.source_tags(spark, sf), "source"),
                                      S.source_activity(spark, sf), cuts, "source", S.SPEC.top_k, ties="name")
        return L.lineage_features(rows, asof)
    return S.stage(spark, sf, "lineage", build)


@query("grandsource_profile", """
SELECT subject, grand, grand_prod, grand_breadth, grand_age, array_to_string(grand_tags, '; ') AS grand_tags,
       round(jac_subject_grand, 6) AS jac_subject_grand, round(jac_source_grand, 6) AS jac_source_grand, has_grand FROM t_lineage""")
def grandsource_profile(spark, sf):
    return lineage(spark, sf).select("subject", "grand", "grand_prod", "grand_breadth", "grand_age", render(F.col("grand_tags")).alias("grand_tags"),
                                     r6(F.col("jac_subject_grand")).alias("jac_subject_grand"), r6(F.col("jac_source_grand")).alias("jac_source_grand"), "has_grand")


@query("interaction_count_asof", """
SELECT p.subject, p.source, sum(n_events)::BIGINT AS n FROM t_pair p JOIN t_bounds b USING (subject) WHERE p.period BETWEEN t0 AND t0 + 5 GROUP BY ALL""")
def interaction_count_asof(spark, sf):
    """Joint events of every edge inside [t0, t0+5]."""
    t0 = S.subjects(spark, sf).select("subject", "t0")
    return (S.pair_activity(spark, sf).join(t0, "subject").where(F.col("period").between(F.col("t0"), F.col("t0") + 5))
            .groupBy("subject", "source").agg(F.sum("n_events").alias("n")))


@query("shared_item_any", """
WITH s AS (SELECT DISTINCT subject, part FROM t_lines WHERE score >= 0.3::DOUBLE), a AS (SELECT DISTINCT source, part FROM t_lines WHERE score >= 0.3::DOUBLE)
SELECT c.subject, c.source, count(a.part) > 0 AS shares FROM t_cohort c LEFT JOIN s ON s.subject = c.subject LEFT JOIN a ON a.source = c.source AND a.part = s.part GROUP BY ALL""")
def shared_item_any(spark, sf):
    """Do subject and source share at least one strong link to the same item?"""
    ok = S.lines(spark, sf).where(F.col("score") >= 0.3)
    c = S.cohort(spark, sf).select("subject", "source")
    mine = c.join(ok.select("subject", "part").distinct(), "subject")
    hit = mine.join(ok.select("source", "part"), ["source", "part"], "left_semi").select("subject").distinct().withColumn("h", F.lit(True))
    return c.join(hit, "subject", "left").select("subject", "source", F.coalesce("h", F.lit(False)).alias("shares"))


cte("t_pctdim", """
SELECT period, cites, (before + (n + 1) / 2.0::DOUBLE) / total AS pct FROM (
 SELECT period, cites, n, coalesce(sum(n) OVER (PARTITION BY period ORDER BY cites ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY period) AS total
 FROM (SELECT period, cites, count(*) AS n FROM t_ev GROUP BY ALL) x) y""")


def percentile_dim(spark, sf):
    return impact.percentile_dim(S.events(spark, sf), "period", "cites")


@query("cited_percentile_lookup", "SELECT event_id, round(pct, 6) AS pct FROM t_ev JOIN t_pctdim USING (period, cites) WHERE period BETWEEN 7800 AND 8007")
def cited_percentile_lookup(spark, sf):
    e = S.events(spark, sf).where(F.col("period").between(S.SPEC.windows.first_valid, S.SPEC.windows.observed_until))
    return e.join(percentile_dim(spark, sf), ["period", "cites"]).select("event_id", r6(F.col("pct")).alias("pct"))


cte("t_hindex", """
SELECT subject, coalesce(max(least(rn, cites)), 0)::BIGINT AS h_index FROM (SELECT subject, cites, row_number() OVER (PARTITION BY subject ORDER BY cites DESC) AS rn FROM t_ev) x GROUP BY subject""")
cte("t_late", """
SELECT s.subject, round(avg(pct), 4) AS late_pct_mean, count(pct) AS late_n FROM t_bounds s JOIN t_ev e ON e.subject = s.subject AND e.period > t0 + 5 AND e.period <= t0 + 15
JOIN t_pctdim d ON d.period = e.period AND d.cites = e.cites GROUP BY s.subject""")
cte("t_outcomes", "SELECT c.subject, c.source, h_index, late_pct_mean, coalesce(late_n, 0) AS late_n FROM t_cohort c JOIN t_hindex USING (subject) LEFT JOIN t_late USING (subject)")


def late_impact(spark, sf):
    b = S.subjects(spark, sf).select("subject", "t0")
    e = S.events(spark, sf).join(b, "subject").where((F.col("period") > F.col("t0") + 5) & (F.col("period") <= F.col("t0") + 15))
    return e.join(percentile_dim(spark, sf), ["period", "cites"]).groupBy("subject").agg(
        F.round(F.avg("pct"), 4).alias("late_pct_mean"), F.count("pct").alias("late_n"))


def outcomes(spark, sf):
    return (S.cohort(spark, sf).select("subject", "source").join(impact.h_index(S.events(spark, sf), "subject", "cites"), "subject")
            .join(late_impact(spark, sf), "subject", "left").withColumn("late_n", F.coalesce("late_n", F.lit(0))))


@query("outcome_join", """
SELECT c.subject, c.source, c.early_overlap, o.late_pct_mean FROM t_cohort c LEFT JOIN t_outcomes o
  ON o.subject = c.subject AND o.source = c.source WHERE o.late_pct_mean IS NOT NULL""")
def outcome_join(spark, sf):
    o = outcomes(spark, sf).select("subject", "source", "late_pct_mean")
    return (S.cohort(spark, sf).select("subject", "source", "early_overlap").join(o, ["subject", "source"], "left")
            .where(F.col("late_pct_mean").isNotNull()))


cte("t_density", """
SELECT n_name AS institution, count(*) AS raw, count(*) FILTER (WHERE c_custkey IN (SELECT subject FROM t_cohort))::DOUBLE / count(*) AS density
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")


def density(spark, sf):
    c = (S.table(spark, sf, "customer").join(S.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
         .select(F.col("c_custkey").alias("subject"), F.col("n_name").alias("institution")))
    m = S.cohort(spark, sf).select("subject", F.lit(1).alias("resolved"))
    return c.join(m, "subject", "left").groupBy("institution").agg(
        F.count(F.lit(1)).alias("raw"), (F.count("resolved").cast("double") / F.count(F.lit(1))).alias("density"))


@query("dim_density_join", """
SELECT min_raw, count(*) AS n_modelled, count(density) AS n_matched, count(*) - count(density) AS n_unmatched, round(avg(density), 6) AS mean_density
FROM (VALUES (0), (60)) a(min_raw) CROSS JOIN t_cohort c LEFT JOIN t_density d ON d.institution = c.institution AND d.raw >= min_raw GROUP BY min_raw""")
def dim_density_join(spark, sf):
    """Institution density joined to the rows; the arm with a minimum raw count leaves some unmatched."""
    d = density(spark, sf)
    c = S.cohort(spark, sf).select("institution").withColumn("min_raw", F.explode(F.array(F.lit(0), F.lit(60))))
    kept = F.when(F.col("raw") >= F.col("min_raw"), F.col("density"))
    return c.join(d, "institution", "left").withColumn("density", kept).groupBy("min_raw").agg(
        F.count(F.lit(1)).alias("n_modelled"), F.count("density").alias("n_matched"),
        (F.count(F.lit(1)) - F.count("density")).alias("n_unmatched"), r6(F.avg("density")).alias("mean_density"))


@query("align_vectors", """
SELECT count(*) AS n_rows, count(vec_id) AS matched, count(*) - count(vec_id) AS missing, round(sum(embedding[1]::DOUBLE), 5) AS first_sum
FROM labels LEFT JOIN embeddings ON vec_id = doc_id""")
def align_vectors(spark, sf):
    """Rows with their vector; ``missing`` above zero is the abort signal."""
    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.lit(1).alias("has"))
    j = S.table(spark, sf, "labels").join(e, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count("has").alias("matched"),
                 (F.count(F.lit(1)) - F.count("has")).alias("missing"), F.round(F.sum(F.get("embedding", 0).cast("double")), 5).alias("first_sum"))


@query("covered_mask", """
SELECT field, arm, count(*) AS n, round(avg(y::DOUBLE), 6) AS base_rate, round(avg(early_overlap), 6) AS mean_overlap
FROM (SELECT *, 'all' AS arm FROM t_lineage UNION ALL SELECT *, 'covered' FROM t_lineage WHERE has_grand = 1) x GROUP BY ALL""")
def covered_mask(spark, sf):
    """All rows against the rows that carry lineage data."""
    rows = lineage(spark, sf).withColumn("arm", F.explode(F.when(F.col("has_grand") == 1, F.array(F.lit("all"), F.lit("covered"))).otherwise(F.array(F.lit("all")))))
    return rows.groupBy("field", "arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("base_rate"), r6(F.avg("early_overlap")).alias("mean_overlap"))


@query("field_roles_map", """
SELECT id, array_to_string(list_sort(list(DISTINCT field)), ';') AS fields FROM (SELECT subject AS id, field FROM t_funnel UNION ALL SELECT source, field FROM t_funnel) x GROUP BY id""")
def field_roles_map(spark, sf):
    """Author to the fields whose table holds it in either role (at most one entry per field)."""
    f = S.funnel(spark, sf)
    both = f.select(F.col("subject").alias("id"), "field").union(f.select("source", "field"))
    return both.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("field")), ";").alias("fields"))
