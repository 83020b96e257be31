"""Scans, sources and sinks."""

from pyspark.sql import functions as F, types as T

from cohortry.functions.columns import r6
from cohortry.plans import stages as S
from cohortry.plans.registry import query
from cohortry.session import checkpoint_root
from cohortry.sources import readers as R, sinks as K
from cohortry.specs import DatasetSpec

import uuid


def scratch(spark, name):
    return f"{checkpoint_root(spark)}/sink/{name}-{uuid.uuid4().hex}"


@query("scan_columnar_pruned", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY l_suppkey")
def scan_columnar_pruned(spark, sf):
    return (R.columns_of(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_quantity"])
            .groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity")).alias("qty")))


@query("scan_delimited_dump", "SELECT c_custkey AS pid, c_name AS lastname, c_mktsegment AS majorarea, CAST(NULL AS INTEGER) AS hindex FROM customer")
def scan_delimited_dump(spark, sf):
    path = scratch(spark, "people")
    (S.table(spark, sf, "customer").select(F.col("c_name").alias("lastname"), F.col("c_custkey").alias("pid"),
                                           F.col("c_mktsegment").alias("majorarea"), F.lit("n/a").alias("hindex"))
     .write.option("header", True).option("compression", "gzip").csv(path))
    return R.delimited_dump(spark, f"{path}/*.csv.gz",
                            {"pid": "bigint", "lastname": "string", "majorarea": "string", "hindex": "int"})


def link_rows(spark, sf):
    """Person-to-work links: customer -> order, with a text id of either kind and a score."""
    e = S.events(spark, sf)
    k = F.col("event_id").cast("string")
    return e.select(F.col("subject").cast("string").alias("pid"), k.alias("pubid"),
                    F.when(F.col("cites") % 3 > 0, k).otherwise("0").alias("pmid"),
                    F.concat(F.lit("https://doi.org/10.1/"), k).alias("doi"),
                    (F.col("cites") / F.lit(50.0)).alias("score_total"))


@query("scan_chunked_links", """
SELECT form, count(*) AS n, count(DISTINCT pid) AS persons, round(sum(score_total), 6) AS total
FROM (SELECT CAST(subject AS VARCHAR) AS pid, cites/50.0::DOUBLE AS score_total FROM t_ev) x, (VALUES ('csv'), ('parquet')) f(form) GROUP BY form""")
def scan_chunked_links(spark, sf):
    rows, a, b = link_rows(spark, sf), scratch(spark, "links"), scratch(spark, "links")
    rows.write.option("header", True).option("compression", "gzip").csv(a)
    rows.write.parquet(b)
    both = R.links(spark, a).withColumn("form", F.lit("csv")).unionByName(R.links(spark, b).withColumn("form", F.lit("parquet")))
    return both.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("persons"),
                                    r6(F.sum("score_total")).alias("total"))


@query("scan_jsonl_last_wins", """
SELECT conv_id, turn, role, length(text) AS chars FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def scan_jsonl_last_wins(spark, sf):
    path = scratch(spark, "store")
    rows = S.table(spark, sf, "conversations")
    good = rows.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    # a cut-off line per conversation, as an interrupted writer leaves behind
    torn = rows.where(F.col("turn") == 0).select("conv_id", F.lit(10**9).cast("bigint").alias("turn"), F.lit('{"conv_id": ').alias("value"))
    (good.unionByName(torn).repartition("conv_id").sortWithinPartitions("turn").select("value").write.text(path))
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return R.jsonl_last_wins(spark, path, schema, "conv_id").select(
        "conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"))


def work_shards(spark, sf):
    """Works of each subject as JSON text, one shard per order status (F, O, P in that order)."""
    ev = S.events(spark, sf).join(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderstatus"), "event_id")
    shard = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    tags = S.subject_tags(spark, sf).groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("tag_pos", "tag"))).alias("t"))
    works = ev.join(tags, "event_id", "left").select(
        F.col("subject").alias("aid"), shard.alias("shard_no"),
        F.struct(F.col("period").alias("year"),
                 F.transform(F.coalesce("t", F.array().cast("array<struct<tag_pos:int,tag:string>>")),
                             lambda s: F.array(s["tag"], F.lit("0.5"))).alias("concepts"),
                 F.col("cites").alias("cited_by_count"), F.col("event_id")).alias("w"))
    return works.groupBy("aid", "shard_no").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("w.event_id").alias("e"), F.col("w").alias("w")))),
                              lambda s: s["w"])).alias("works_json"))


@query("scan_nested_json_shards", """
WITH s AS (SELECT e.subject AS aid, e.event_id, period, cites, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS shard_no
           FROM t_ev e JOIN orders ON o_orderkey = event_id),
m AS (SELECT aid, max(shard_no) AS shard_no FROM s GROUP BY aid)
SELECT s.aid, s.shard_no, count(*) AS n_works, min(period) AS first_period, sum(cites)::BIGINT AS cites,
       sum((SELECT count(*) FROM t_stags t WHERE t.event_id = s.event_id))::BIGINT AS n_tags
FROM s JOIN m USING (aid, shard_no) GROUP BY ALL""")
def scan_nested_json_shards(spark, sf):
    typed = R.nested_shards(work_shards(spark, sf), "aid", "works_json", "shard_no")
    return typed.select("aid", "shard_no", F.size("works").cast("bigint").alias("n_works"),
                        F.array_min(F.transform("works", lambda w: w["year"])).alias("first_period"),
                        F.aggregate("works", F.lit(0).cast("bigint"), lambda a, w: a + w["cited_by_count"]).alias("cites"),
                        F.aggregate("works", F.lit(0).cast("bigint"), lambda a, w: a + F.size(w["concepts"])).alias("n_tags"))


@query("resume_todo", """
SELECT DISTINCT id FROM (SELECT subject AS id FROM t_edges UNION ALL SELECT source FROM t_edges) w
WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def resume_todo(spark, sf):
    e = S.edges(spark, sf)
    wanted = e.select(F.col("subject").alias("id")).union(e.select(F.col("source")))
    stored = S.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct()
    return R.outstanding(wanted, stored, ["id"])


@query("repair_empty", """
WITH c AS (SELECT c_custkey AS aid, count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS p, count(o_orderkey) AS a
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT aid, CASE WHEN p = 0 THEN a ELSE p END AS n_works, p = 0 AS repaired FROM c""")
def repair_empty(spark, sf):
    stored = (S.table(spark, sf, "customer").select(F.col("c_custkey").alias("aid")).join(
        S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("aid")).agg(
            F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count(F.lit(1)).alias("a")), "aid", "left")
        .select("aid", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("a", F.lit(0)).alias("a")))
    empty = stored.where(F.col("p") == 0)
    merged = empty.select("aid", F.col("a").alias("n_works"), F.lit(True).alias("repaired"))
    kept = stored.select("aid", F.col("p").alias("n_works"), F.lit(False).alias("repaired"))
    return R.upsert(kept, merged, ["aid"])


@query("sink_frozen_table", """
SELECT subject, source, t0, y, array_to_string(early_tags, '; ') AS early_tags, array_to_string(source_tags, '; ') AS source_tags FROM t_cohort""")
def sink_frozen_table(spark, sf):
    folder = scratch(spark, "frozen")
    cols = ["subject", "source", "t0", "y", "early_tags", "source_tags"]
    K.frozen_table(S.cohort(spark, sf).select(*cols), folder)
    back = spark.read.schema("subject long, source long, t0 int, y int, early_tags string, source_tags string").option("header", True).option("nullValue", "\\N").csv(f"{folder}/csv")
    return back.select(*cols)


@query("sink_event_table", """
SELECT CAST(subject AS VARCHAR) AS author_id, period AS publication_year, count(*) AS n, count(DISTINCT tag) AS tags
FROM t_lines GROUP BY subject, period""")
def sink_event_table(spark, sf):
    folder = scratch(spark, "events")
    K.event_table(S.lines(spark, sf).select(F.col("subject").alias("author_id"), F.col("period").alias("publication_year"),
                                            F.col("tag").alias("concept"), "score"), folder)
    return (spark.read.schema(R.EVENT_TABLE).parquet(folder).groupBy("author_id", F.col("publication_year").cast("int").alias("publication_year"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("concept").alias("tags")))


FINGERPRINTED = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "documents": ["doc_id", "text", "lang", "source"],
}


@query("content_fingerprint", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(sum(('0x' || substr(md5(concat_ws('|', {', '.join(c)})), 1, 8))::BIGINT) AS VARCHAR) AS fingerprint FROM {t}"
    for t, c in FINGERPRINTED.items()))
def content_fingerprint(spark, sf):
    out = None
    for t, cols in FINGERPRINTED.items():
        one = R.row_fingerprint(S.table(spark, sf, t), [F.col(c).cast("string") for c in cols]).select(F.lit(t).alias("table_name"), "n_rows", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out


@query("file_fingerprint")
def file_fingerprint(spark, sf):
    """SHA-256 of the input files themselves."""
    return R.file_digests(spark, f"{sf}/*.parquet")


@query("dataset_summary", """
SELECT field, count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT institution) AS n_institutions,
       round(avg(y::DOUBLE), 4) AS base_rate, min(t0) AS t0_min, max(t0) AS t0_max,
       round(avg(CASE WHEN interaction_n >= 0 THEN interacted::INTEGER::DOUBLE END), 4) AS interaction_rate,
       round(avg((institution IS NULL)::INTEGER::DOUBLE), 4) AS institution_missing
FROM t_cohort GROUP BY field""")
def dataset_summary(spark, sf):
    flag = F.col("interacted").cast("double")
    return S.cohort(spark, sf).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"),
        F.count_distinct("institution").alias("n_institutions"), F.round(F.avg("y"), 4).alias("base_rate"),
        F.min("t0").alias("t0_min"), F.max("t0").alias("t0_max"),
        F.round(F.avg(F.when(F.col("interaction_n") >= 0, flag)), 4).alias("interaction_rate"),
        F.round(F.avg(F.col("institution").isNull().cast("double")), 4).alias("institution_missing"))


@query("split_manifest", "SELECT field, split, count(*) AS n, 0::BIGINT AS lost, 0::BIGINT AS added FROM t_split GROUP BY ALL")
def split_manifest(spark, sf):
    folder = scratch(spark, "manifest")
    now = S.split(spark, sf).select("field", "split", "subject")
    now.write.partitionBy("field", "split").parquet(folder)
    back = spark.read.schema("subject long, field string, split string").parquet(folder)
    both = (now.withColumn("a", F.lit(1)).withColumn("b", F.lit(0))
            .unionByName(back.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
            .groupBy("field", "split", "subject").agg(F.max("a").alias("a"), F.max("b").alias("b")))
    return both.groupBy("field", "split").agg(
        F.sum("b").alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("lost"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("added"))


def pair_run(spark, sf, status):
    o = S.table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("event_id"))
    return S.lines(spark, sf).join(o, "event_id").select("subject", "source").distinct()


PAIR_RUNS = """
WITH r AS (SELECT DISTINCT subject, source FROM t_lines JOIN orders ON o_orderkey = event_id WHERE o_orderstatus = 'F'),
n AS (SELECT DISTINCT subject, source FROM t_lines JOIN orders ON o_orderkey = event_id WHERE o_orderstatus = 'O')
"""


@query("manifest_diff", PAIR_RUNS + """
SELECT count(*) FILTER (WHERE r.subject IS NOT NULL AND n.subject IS NOT NULL) AS overlap,
       count(*) FILTER (WHERE n.subject IS NULL) AS ref_only, count(*) FILTER (WHERE r.subject IS NULL) AS new_only,
       round(count(*) FILTER (WHERE r.subject IS NOT NULL AND n.subject IS NOT NULL)::DOUBLE / count(r.subject), 6) AS ratio
FROM r FULL JOIN n ON r.subject = n.subject AND r.source = n.source""")
def manifest_diff(spark, sf):
    return diff_counts(pair_run(spark, sf, "F"), pair_run(spark, sf, "O"), ["subject", "source"])


def diff_counts(ref, new, keys):
    """Overlap of two key sets in one shuffle: union with side flags, then one aggregate."""
    both = (ref.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(new.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
            .groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b")))
    common = F.count_if((F.col("a") == 1) & (F.col("b") == 1))
    return both.agg(common.alias("overlap"), F.count_if(F.col("b") == 0).alias("ref_only"),
                    F.count_if(F.col("a") == 0).alias("new_only"),
                    r6(F.try_divide(common.cast("double"), F.sum("a"))).alias("ratio"))


@query("metric_sink_nested", """
SELECT field, round(avg(y::DOUBLE), 6) AS base_rate, round(avg(late_overlap), 6) AS late_overlap, count(*)::DOUBLE AS n FROM t_cohort GROUP BY field""")
def metric_sink_nested(spark, sf):
    folder = scratch(spark, "metrics")
    m = S.cohort(spark, sf).groupBy("field").agg(
        r6(F.avg("y")).alias("base_rate"), r6(F.avg("late_overlap")).alias("late_overlap"), F.count(F.lit(1)).cast("double").alias("n"))
    K.nested_metrics(m.unpivot("field", ["base_rate", "late_overlap", "n"], "metric", "value"), ["field"]).write.json(folder)
    doc = F.from_json("document", "map<string,double>")
    return (spark.read.schema("field string, document string").json(folder).withColumn("d", doc)
            .select("field", F.col("d")["base_rate"].alias("base_rate"), F.col("d")["late_overlap"].alias("late_overlap"), F.col("d")["n"].alias("n")))


@query("table_catalog_by_field", "SELECT field, count(*) AS n, sum(subject)::BIGINT AS key_sum FROM t_cohort GROUP BY field")
def table_catalog_by_field(spark, sf):
    root = scratch(spark, "catalog")
    S.cohort(spark, sf).select("field", "subject", "t0", "y").write.partitionBy("field").parquet(f"{root}/cohort")
    fields = spark.read.parquet(f"{root}/cohort").select("field").distinct().orderBy("field").collect()  # one row per dataset
    out = None
    for (name,) in fields:  # one reader per dataset switch, one job over all of them
        spec = DatasetSpec(name, root)
        one = spark.read.schema("subject long, t0 int, y int").parquet(spec.table("cohort")).select(F.lit(name).alias("field"), "subject")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("subject").alias("key_sum"))
