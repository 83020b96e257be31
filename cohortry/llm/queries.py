"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from cohortry.llm import bpe, decontaminate, html, jaccard, linedup, negatives, paragraphs, pii, quality, simhash, toxicity, warc, whitening
from cohortry.llm.common import DataFrame, F, SparkSession, materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op7_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.histories(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "place")


SQL["op5_warc_index_merge"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\r\n]+', '%0A', 'g') AS url, strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM pages),
     u AS (SELECT *, regexp_extract(url, '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)(?::[0-9]+)?([^#]*)', ['host', 'path'], 'i') AS m, regexp_matches(url, '^[a-z][a-z0-9+.-]*://', 'i') AS whole FROM p),
     k AS (SELECT page_id, html, stamp, CASE WHEN whole THEN array_to_string(list_reverse(string_split(regexp_replace(lower(m.host), '^www\.', ''), '.')), ',') || ')' || lower(CASE WHEN m.path = '' THEN '/' ELSE m.path END) ELSE lower(url) END AS url_key FROM u),
     q AS (SELECT page_id, html, url_key, stamp, octet_length(encode(html)) AS n, min(page_id) OVER (PARTITION BY html) AS low, row_number() OVER (ORDER BY url_key, stamp, page_id NULLS FIRST) AS place FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND low < page_id THEN low END AS refers_to, url_key, stamp, place
FROM q
"""


@query
def op8_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(quality.statistics(table(spark, sf_dir, "documents")), "quality")
    judged = quality.judge(stats, quality.fit(stats, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_decontaminate_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal lines (``word`` is null), and passages that repeat across documents wherever they begin."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "paragraph", "word", "n_words", "cluster_id", "cluster_size", "kept"]
    lines = paragraphs.clusters(docs).withColumn("word", F.lit(None).cast("long"))
    return lines.select(*columns).unionByName(paragraphs.passages(docs).select(*columns))


@query
def op9_line_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(table(spark, sf_dir, "documents"))


SQL["op9_line_suffix_array"] = linedup.REPORT_SQL


@query
def op4_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op6_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.detect(docs, pii.fit(docs))


SQL["op10_decontaminate_prefix_join"] = decontaminate.REPORT_SQL


@query
def op11_whitening_secular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_hard_negatives_l2ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = t.select("vec_id", shifted.alias("label"), whitening.scaled("embedding").alias("x"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives_l2ap"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
           FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


@query
def op13_jaccard_size_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


SQL["op13_jaccard_size_tiles"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(g) AS g FROM (SELECT doc_id, s, unnest(s) AS g FROM s)),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""
