"""Graph queries."""

from pyspark.sql import Window as W, functions as F

from cohortry.functions.columns import r6
from cohortry.operators import draws as D, graph as G, metrics as M, peers, stats
from cohortry.operators.ordering import attach, first_by
from cohortry.plans import joins as J, stages as S
from cohortry.plans.aggregates import institution_labels, n_rows, pair_graph
from cohortry.plans.evaluation import auc_sql
from cohortry.session import materialise
from cohortry.plans.registry import cte, query

cte("t_wedges", """
WITH f AS (SELECT source, count(*)::DOUBLE AS n FROM t_cohort GROUP BY source),
e AS (SELECT c.source AS src, c.subject AS dst, 1.0::DOUBLE / n AS w FROM t_cohort c JOIN f USING (source) UNION ALL SELECT source, subject, 0.5 FROM t_cohort WHERE interacted UNION ALL SELECT subject, source, 0.5 FROM t_cohort WHERE interacted
 UNION ALL SELECT subject, source, 0.3 FROM t_cohort WHERE early_overlap > 0.2::DOUBLE UNION ALL SELECT source, subject, 0.3 FROM t_cohort WHERE y = 1)
SELECT src, dst, sum(w)::DOUBLE AS weight FROM e WHERE src <> dst GROUP BY ALL""")


def weighted(spark, sf):
    rows = S.cohort(spark, sf).select("source", "subject", "interacted", (F.col("early_overlap") > 0.2).alias("subject_refers"), (F.col("y") == 1).alias("source_refers"))
    return G.weighted_edges(rows)


@query("weighted_edges", "SELECT src, dst, round(weight, 6) AS weight FROM t_wedges")
def weighted_edges(spark, sf):
    return weighted(spark, sf).select("src", "dst", r6(F.col("weight")).alias("weight"))


def pr_sql(rounds):
    step = ["n AS (SELECT src AS node FROM t_wedges UNION SELECT dst FROM t_wedges)", "o AS (SELECT src, sum(weight) AS t FROM t_wedges GROUP BY src)",
            "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for i in range(rounds):
        step.append(f"""r{i + 1} AS (SELECT n.node, 0.85::DOUBLE * (coalesce(c.v, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) + 0.15::DOUBLE / (SELECT count(*) FROM n) AS r
 FROM n LEFT JOIN (SELECT dst, sum(r * weight / t) AS v FROM r{i} JOIN t_wedges ON src = node JOIN o USING (src) GROUP BY dst) c ON c.dst = n.node)""")
    return "WITH " + ",\n".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in step) + f" SELECT node, round(r, 6) AS rank FROM r{rounds}"


@query("pagerank_weighted", pr_sql(100))
def pagerank_weighted(spark, sf):
    """All hundred rounds: a stop on the change leaves ranks that differ from them in the sixth digit."""
    return G.pagerank(weighted(spark, sf), tol=0.0).select("node", r6(F.col("rank")).alias("rank"))


cte("t_tree", "SELECT DISTINCT least(pid, parent) AS a, greatest(pid, parent) AS b FROM t_parent JOIN t_cohort ON subject = pid WHERE pid <> parent")
COMP_SQL = """
WITH RECURSIVE n AS (SELECT a AS node FROM t_tree UNION SELECT b FROM t_tree), e AS (SELECT a, b FROM t_tree UNION ALL SELECT b, a FROM t_tree),
w AS (SELECT node, node AS reach FROM n UNION SELECT w.node, e.b FROM w JOIN e ON e.a = w.reach)
"""


def tree(spark, sf):
    """Undirected parent graph of the cohort's subjects in the shared person id space."""
    p = J.parents(spark, sf).join(S.cohort(spark, sf).select(F.col("subject").alias("pid")), "pid", "left_semi")
    return p.where("pid <> parent").select(F.least("pid", "parent").alias("src"), F.greatest("pid", "parent").alias("dst")).distinct()


@query("components", COMP_SQL + "SELECT node, min(reach) AS component FROM w GROUP BY node")
def components(spark, sf):
    return G.components(tree(spark, sf))


@query("largest_component", COMP_SQL + """, c AS (SELECT node, min(reach) AS component FROM w GROUP BY node)
SELECT component, count(*) AS size FROM c GROUP BY component ORDER BY size DESC, component LIMIT 1""")
def largest_component(spark, sf):
    return G.components(tree(spark, sf)).groupBy("component").agg(n_rows("size")).orderBy(F.col("size").desc(), "component").limit(1)


COMMUNITY_SEEDS, NULL_DRAWS = 10, 100


@query("communities", COMP_SQL + f", g AS (SELECT count(*) AS nodes FROM n) SELECT CAST(s AS INTEGER) AS seed, nodes, true AS whole, true AS settled FROM g, range({COMMUNITY_SEEDS}) r(s)")
def communities(spark, sf):
    """Invariants of the search per seed: every node has one community, and the modularity beats that of one
    community per component, the start of any search that may not cut a component."""
    g = tree(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(COMMUNITY_SEEDS - 1))))
    lab = G.communities(g, ["seed"])
    comp = G.components(tree(spark, sf)).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(COMMUNITY_SEEDS - 1)))).withColumnRenamed("component", "community")
    q = stats.modularity(g, lab, ["seed"]).select("seed", "q", "n_communities").join(stats.modularity(g, comp, ["seed"]).select("seed", F.col("q").alias("q0"), F.col("n_communities").alias("c0")), "seed")
    per = lab.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node").alias("nodes"))
    return per.join(q, "seed").select("seed", "nodes", (F.col("n") == F.col("nodes")).alias("whole"), ((F.col("q") >= F.col("q0")) & (F.col("n_communities") >= F.col("c0"))).alias("settled"))


@query("community_modularity")
def community_modularity(spark, sf):
    """Number of communities and modularity per seed, on the parent graph."""
    g = tree(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(COMMUNITY_SEEDS - 1))))
    return stats.modularity(g, G.communities(g, ["seed"]), ["seed"])


@query("null_z")
def null_z(spark, sf):
    """Modularity found by the search on the largest component of the pair graph, against the modularity the
    same search finds on random assignments and on graphs with the same degrees. All graphs are searched in
    one job per round."""
    e = pair_graph(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    comp = G.components(e)
    largest = comp.groupBy("component").agg(n_rows("size")).orderBy(F.col("size").desc(), "component").limit(1)
    inside = comp.join(largest, "component").select(F.col("node").alias("src"))
    e = materialise(e.join(inside, "src", "left_semi"), "largest")
    deal = D.random_assignment_null(e, "src", "dst", NULL_DRAWS).select(F.lit("assignment").alias("null"), "draw", "src", "dst").distinct()
    conf = D.configuration_null(e, NULL_DRAWS).select(F.lit("configuration").alias("null"), "draw", "src", "dst")
    graphs = materialise(e.select(F.lit("observed").alias("null"), F.lit(0).alias("draw"), "src", "dst").unionByName(deal).unionByName(conf), "nulls")
    keys = ["null", "draw"]
    q = materialise(stats.modularity(graphs, G.communities(graphs, keys), keys), "null-q")
    z = q.where(F.col("null") != "observed").groupBy("null").agg(F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"))
    j = attach(z, q.where(F.col("null") == "observed").agg(F.max("q").alias("observed")), [])
    j = j.withColumn("z", F.try_divide(F.col("observed") - F.col("mean"), F.col("sd")))
    return j.withColumn("verdict", F.when(F.min(F.col("z")).over(W.partitionBy(F.lit(0))) > 2, "supported").otherwise("artifact"))  # two rows


@query("bfs_neighbourhood", """
WITH RECURSIVE e AS (SELECT a, b FROM t_tree UNION ALL SELECT b, a FROM t_tree), h AS (SELECT a AS node FROM e GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
w AS (SELECT node, 0 AS level FROM h UNION SELECT e.b, w.level + 1 FROM w JOIN e ON e.a = w.node WHERE w.level < 12)
SELECT node, CAST(min(level) AS INTEGER) AS level FROM w GROUP BY node ORDER BY min(level), node LIMIT 150""")
def bfs_neighbourhood(spark, sf):
    """150 nodes around the hub (the cut is the feature)."""
    g = tree(spark, sf)
    hub = g.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count().orderBy(F.col("count").desc(), "node").limit(1).select("node")
    return G.neighbourhood(g, hub, 150)


def walk_sql(walks, steps):
    """Steps unrolled: the neighbour at place hash mod degree."""
    out = ["p AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY md5(concat_ws('|', a, b)), b) AS place, count(*) OVER (PARTITION BY a) AS deg FROM (SELECT a, b FROM t_tree UNION ALL SELECT b, a FROM t_tree) x)",
           f"w0 AS (SELECT a AS node, w AS walk, a AS cur, CAST(a AS VARCHAR) AS path FROM (SELECT DISTINCT a FROM p) d, range({walks}) r(w))"]
    for i in range(1, steps):
        out.append(f"""w{i} AS (SELECT node, walk, p.b AS cur, path || '>' || CAST(p.b AS VARCHAR) AS path FROM w{i - 1} JOIN p ON p.a = cur AND p.place = ('0x' || substr(md5(concat_ws('|', 0, 'walk', node, walk, {i})), 1, 12))::BIGINT % deg + 1)""")
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in out) + f" SELECT node, CAST(walk AS INTEGER) AS walk, path FROM w{steps - 1}"


@query("random_walks", walk_sql(10, 40))
def random_walks(spark, sf):
    """Ten walks of forty nodes from every node of the parent graph."""
    w = G.random_walks(tree(spark, sf), walks=10, steps=40, cut_every=10)
    return w.select("node", "walk", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def typed_sql(a, src="t_cohort"):
    return f"""SELECT DISTINCT rel, src, dst FROM (
 SELECT 'studies' AS rel, 's:' || CAST(subject AS VARCHAR) AS src, 't:' || unnest(early_tags) AS dst FROM {src} UNION ALL SELECT 'source_studies', {a}, 't:' || unnest(source_tags) FROM {src}
 UNION ALL SELECT 'advises', {a}, 's:' || CAST(subject AS VARCHAR) FROM {src} UNION ALL SELECT 'at', 's:' || CAST(subject AS VARCHAR), 'i:' || institution FROM {src} WHERE institution IS NOT NULL
 UNION ALL SELECT 'coauth', 's:' || CAST(subject AS VARCHAR), {a} FROM {src} WHERE interacted) x"""


def mirror_sql(t):
    return f"SELECT rel, src, dst FROM {t} UNION ALL SELECT 'rev_' || rel, dst, src FROM {t}"


cte("t_legacy", typed_sql("'a:' || CAST(source AS VARCHAR)"))
cte("t_strict", typed_sql("'a:' || CAST(source AS VARCHAR) || '@' || CAST(t0 AS VARCHAR)"))


@query("typed_edges_legacy", mirror_sql("t_legacy"))
def typed_edges_legacy(spark, sf):
    return G.mirror(G.typed_edges(S.cohort(spark, sf), False))


@query("typed_edges_strict", mirror_sql("t_strict"))
def typed_edges_strict(spark, sf):
    """Sources keyed by cohort; the prior-sibling relation of this graph is ``sibling_edges``."""
    return G.mirror(G.typed_edges(S.cohort(spark, sf), True))


@query("typed_nodes_strict", "SELECT 'a:' || CAST(source AS VARCHAR) || '@' || CAST(t0 AS VARCHAR) AS node, round(avg(source_prod::DOUBLE), 6) AS source_prod, round(avg(source_breadth::DOUBLE), 6) AS source_breadth, round(avg(source_age::DOUBLE), 6) AS source_age FROM t_cohort GROUP BY source, t0")
def typed_nodes_strict(spark, sf):
    return strict_nodes(spark, sf).select(F.concat(F.lit("a:"), "source", F.lit("@"), "t0").alias("node"), *[r6(F.col(c)).alias(c) for c in ("source_prod", "source_breadth", "source_age")])


def strict_nodes(spark, sf):
    return S.cohort(spark, sf).groupBy("source", "t0").agg(*[F.avg(c).alias(c) for c in ("source_prod", "source_breadth", "source_age")])


@query("typed_edges_halves", """
WITH s AS (SELECT i.t0 >= j.t0 AS prior FROM t_cohort i JOIN t_cohort j ON i.source = j.source AND i.subject <> j.subject)
SELECT 'f1a' AS contract, (SELECT count(*) FROM t_strict WHERE rel IN ('advises', 'coauth', 'source_studies')) AS source_edges, (SELECT count(*) FROM s) AS sibling_edges UNION ALL
SELECT 'f1b', (SELECT count(*) FROM t_legacy WHERE rel IN ('advises', 'coauth', 'source_studies')), (SELECT count(*) FROM s WHERE prior)""")
def typed_edges_halves(spark, sf):
    """f1a: cohort keying, siblings of all cohorts. f1b: one node per source, prior siblings only."""
    c = S.cohort(spark, sf)

    def arm(name, by_cohort, prior):
        e = G.typed_edges(c, by_cohort).where(F.col("rel").isin("advises", "coauth", "source_studies")).agg(n_rows("source_edges"))
        b = peers.sibling_blocks(c, prior_only=prior).agg(F.sum("n_edges").alias("sibling_edges"))
        return attach(e, b, []).select(F.lit(name).alias("contract"), "source_edges", "sibling_edges")
    return arm("f1a", True, False).unionByName(arm("f1b", False, True))


LIN = """
WITH g AS (SELECT *, 'a:' || CAST(source AS VARCHAR) || '@' || CAST(t0 AS VARCHAR) AS ak, 'a:' || CAST(grand AS VARCHAR) || '@' || CAST(t0 AS VARCHAR) AS gk FROM t_lineage WHERE grand IS NOT NULL),
m AS (SELECT DISTINCT 'mentored_by' AS rel, ak AS src, gk AS dst FROM g WHERE ak <> gk), l AS (SELECT DISTINCT 'studies_lineage' AS rel, gk AS src, 't:' || unnest(grand_tags) AS dst FROM g)
"""


def lineage_relations(spark, sf):
    a, g = F.concat(F.lit("a:"), "source", F.lit("@"), "t0"), F.concat(F.lit("a:"), "grand", F.lit("@"), "t0")
    r = J.lineage(spark, sf).where(F.col("grand").isNotNull()).select(a.alias("ak"), g.alias("gk"), "grand_tags")
    m = r.where("ak <> gk").select(F.lit("mentored_by").alias("rel"), F.col("ak").alias("src"), F.col("gk").alias("dst")).distinct()
    tags = F.explode(F.transform("grand_tags", lambda t: F.concat(F.lit("t:"), t)))
    t = r.select(F.lit("studies_lineage").alias("rel"), F.col("gk").alias("src"), tags.alias("dst")).distinct()
    return r, m.unionByName(t)


@query("typed_edges_lineage", LIN + "SELECT * FROM m UNION ALL SELECT * FROM l")
def typed_edges_lineage(spark, sf):
    """The two ancestry relations added to the strict graph; a source that is its own parent adds none."""
    return lineage_relations(spark, sf)[1]


@query("typed_edges_lineage_stats", LIN + """
SELECT (SELECT count(*) FROM m) AS ancestry_edges, (SELECT count(*) FROM l) AS lineage_tag_edges, (SELECT count(*) FROM g WHERE ak = gk) AS self_rows_dropped, (SELECT count(*) FROM g) AS rows_with_ancestry,
 (SELECT count(DISTINCT gk) FROM g WHERE gk NOT IN (SELECT 'a:' || CAST(source AS VARCHAR) || '@' || CAST(t0 AS VARCHAR) FROM t_cohort)) AS grand_only_nodes""")
def typed_edges_lineage_stats(spark, sf):
    r, e = lineage_relations(spark, sf)
    direct = S.cohort(spark, sf).select(F.concat(F.lit("a:"), "source", F.lit("@"), "t0").alias("gk")).distinct()
    a = e.agg(F.count_if(F.col("rel") == "mentored_by").alias("ancestry_edges"), F.count_if(F.col("rel") == "studies_lineage").alias("lineage_tag_edges"))
    b = r.agg(F.count_if(F.col("ak") == F.col("gk")).alias("self_rows_dropped"), n_rows("rows_with_ancestry"))
    c = r.select("gk").distinct().join(direct, "gk", "left_anti").agg(n_rows("grand_only_nodes"))
    return attach(attach(a, b, []), c, [])


ABLATIONS = {"none": (), "social": ("advises", "at", "coauth"), "advising": ("advises",), "institution": ("at",), "coauth": ("coauth",), "subject_tag": ("studies",), "source_tag": ("source_studies",)}


@query("edge_ablation", "SELECT ablation, count(*) AS kept FROM t_legacy, (VALUES " + ", ".join(f"('{k}', {list(v) if v else '[]::VARCHAR[]'})" for k, v in ABLATIONS.items()) + ") a(ablation, dropped) WHERE NOT list_contains(dropped, rel) GROUP BY ablation")
def edge_ablation(spark, sf):
    """Edges left under each ablation: an edge carries the list of ablations that keep it."""
    rels = G.typed_edges(S.cohort(spark, sf), False).groupBy("rel").agg(n_rows())
    arms = F.array(*[F.struct(F.lit(k).alias("ablation"), (~F.col("rel").isin(*v) if v else F.lit(True)).alias("keep")) for k, v in ABLATIONS.items()])
    return rels.select("n", F.explode(arms).alias("a")).where("a.keep").groupBy("a.ablation").agg(F.sum("n").alias("kept"))


@query("edge_future_exposure", """
SELECT field, count(*) AS n_test, round(avg((lead > 0)::INT::DOUBLE), 6) AS exposed_share, CAST(max(greatest(lead, 0)) AS INTEGER) AS max_lead FROM (
 SELECT i.field, i.subject, coalesce(max(j.t0) - any_value(i.t0), 0) AS lead FROM t_split i LEFT JOIN t_split j ON j.source = i.source WHERE i.split = 'test' GROUP BY ALL) x GROUP BY field""")
def edge_future_exposure(spark, sf):
    """Test rows that reach a later sibling through their source: the latest cohort of a source decides."""
    c = S.split(spark, sf)
    last = c.groupBy("source").agg(F.max("t0").alias("last"))
    t = c.where("split = 'test'").join(last, "source").withColumn("lead", F.col("last") - F.col("t0"))
    return t.groupBy("field").agg(n_rows("n_test"), r6(F.avg((F.col("lead") > 0).cast("int"))).alias("exposed_share"), F.max("lead").alias("max_lead"))


@query("source_feature_skew", """
WITH d AS (SELECT source, t0 AS donor_t0 FROM t_cohort QUALIFY row_number() OVER (PARTITION BY source ORDER BY early_prod DESC, subject) = 1)
SELECT field, count(*) AS n, count(*) FILTER (WHERE donor_t0 > t0) AS later_donor, count(*) FILTER (WHERE donor_t0 < t0) AS earlier_donor FROM t_cohort JOIN d USING (source) GROUP BY field""")
def source_feature_skew(spark, sf):
    """Rows whose collapsed source features (first row wins) are as of a later cohort than their own."""
    c = S.cohort(spark, sf)
    donor = first_by(c, ["source"], [-F.col("early_prod"), F.col("subject")], [F.col("t0").alias("donor_t0")])
    return c.join(donor, "source").groupBy("field").agg(n_rows(), F.count_if(F.col("donor_t0") > F.col("t0")).alias("later_donor"), F.count_if(F.col("donor_t0") < F.col("t0")).alias("earlier_donor"))


cte("t_tagscore", """
WITH tr AS (SELECT field, t0, y, unnest(early_tags) AS tag FROM t_split WHERE split = 'train'), te AS (SELECT field, subject, t0, y, unnest(early_tags) AS tag FROM t_split WHERE split = 'test'),
pa AS (SELECT field, tag, avg(y::DOUBLE) AS prior FROM tr GROUP BY ALL), pc AS (SELECT tr.field, tr.tag, c.t0, avg(tr.y::DOUBLE) AS prior FROM tr JOIN (SELECT DISTINCT field, t0 FROM te) c ON c.field = tr.field AND tr.t0 + 15 <= c.t0 + 5 GROUP BY ALL)
SELECT te.field, 'all' AS arm, te.subject, any_value(te.y) AS y, round(coalesce(avg(pa.prior), 0), 6) AS score FROM te LEFT JOIN pa ON pa.field = te.field AND pa.tag = te.tag GROUP BY te.field, te.subject
UNION ALL SELECT te.field, 'closed', te.subject, any_value(te.y), round(coalesce(avg(pc.prior), 0), 6) FROM te LEFT JOIN pc ON pc.field = te.field AND pc.tag = te.tag AND pc.t0 = te.t0 GROUP BY te.field, te.subject""")


@query("tag_prior_closed", f"SELECT field, arm, round(auc, 5) AS auc, rows_n AS n FROM ({auc_sql('t_tagscore', ['field', 'arm'])}) x")
def tag_prior_closed(spark, sf):
    """AUC of a label prior per tag, taken from all training rows or only from rows whose label window
    had closed at the test row's freeze."""
    c = S.split(spark, sf).select("field", "subject", "t0", "y", "split", F.explode("early_tags").alias("tag"))
    te = c.where("split = 'test'").drop("split")
    fold = c.where("split = 'train'").groupBy("field", "tag", "t0").agg(F.sum("y").alias("pos"), n_rows())
    pa = fold.groupBy("field", "tag").agg((F.sum("pos") / F.sum("n")).alias("prior"))
    cuts = te.select("field", F.col("t0").alias("cut")).distinct()
    pc = (fold.join(cuts, "field").where(F.col("t0") + 10 <= F.col("cut")).groupBy("field", "tag", F.col("cut").alias("t0")).agg((F.sum("pos") / F.sum("n")).alias("prior")))

    def score(t, arm):
        return t.groupBy("field", "subject", "y").agg(F.round(F.coalesce(F.avg("prior"), F.lit(0.0)), 6).alias("score")).withColumn("arm", F.lit(arm))
    both = score(te.join(pa, ["field", "tag"], "left"), "all").unionByName(score(te.join(pc, ["field", "tag", "t0"], "left"), "closed"))
    return M.auc_roc(both, ["field", "arm"]).select("field", "arm", F.round("auc", 5).alias("auc"), F.col("rows").alias("n"))


@query("node_feature_table", """
WITH n AS (SELECT source, t0, avg(source_prod::DOUBLE) AS p FROM t_cohort GROUP BY ALL), s AS (SELECT avg(p) AS m, greatest(stddev_pop(p), 1e-9) AS sd, min(t0) AS lo, max(t0) AS hi FROM n)
SELECT source, t0, 'direct' AS block, round((p - m) / sd, 5) AS z, round((t0 - lo)::DOUBLE / greatest(hi - lo, 1), 6) AS t0_norm FROM n, s
UNION ALL SELECT g.grand, g.t0, 'grand', round((g.p - m) / sd, 5), round((g.t0 - lo)::DOUBLE / greatest(hi - lo, 1), 6) FROM (
 SELECT grand, t0, avg(grand_prod::DOUBLE) AS p FROM t_lineage l WHERE grand IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.source = l.grand AND n.t0 = l.t0) GROUP BY ALL) g, s""")
def node_feature_table(spark, sf):
    """Source nodes standardised on the direct block only; ancestors get the same transform."""
    d = strict_nodes(spark, sf).select("source", "t0", F.col("source_prod").alias("p"), F.lit("direct").alias("block"))
    s = d.agg(F.avg("p").alias("m"), F.greatest(F.stddev_pop("p"), F.lit(1e-9)).alias("sd"), F.min("t0").alias("lo"), F.max("t0").alias("hi"))
    g = (J.lineage(spark, sf).where(F.col("grand").isNotNull()).groupBy(F.col("grand").alias("source"), "t0").agg(F.avg("grand_prod").alias("p"))
         .join(d.select("source", "t0"), ["source", "t0"], "left_anti").withColumn("block", F.lit("grand")))
    j = attach(d.unionByName(g), s, [])
    return j.select("source", "t0", "block", F.round((F.col("p") - F.col("m")) / F.col("sd"), 5).alias("z"), r6((F.col("t0") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).alias("t0_norm"))
