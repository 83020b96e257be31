"""Line dedup in DataFrame operations: a suffix array over line-ID sequences by prefix doubling.

The lines of a document are a sequence of IDs. Sorting the suffixes of all sequences by their first 1, 2,
4, ... lines gives every place a label that is ascending in that order and equal for equal prefixes: the
places with one label are the interval of the suffix array whose longest common prefix has at least that
many lines. A run of any length lies in one interval if and only if the labels of its first and of its
last 2^j lines agree, so a run is looked up with two labels. Doubling stops when no run under test is longer or no
prefix occurs twice.

A line that occurs once cannot be in a repeated run, so only repeated lines are kept, and each doubling
drops the places whose prefix occurs once.
"""

from __future__ import annotations

from pyspark.sql import Window as W

from cohortry.llm.common import DataFrame, F, materialise, plain, row_key

NO_ID = -(1 << 63)
AT = ["doc", "key", "line"]


def _words(line) -> F.Column:
    """Words of a line, or what its length stands for where that is more: a word for every 24 code points, so that a long
    line of a script without blanks counts as long."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(n == 0, 0).otherwise(F.greatest(n, F.floor(F.length(line) / 24).cast("int")))


def _labels(groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """``groups`` (distinct in ``by``) with a label that ascends in the order of ``by``: ranges are dealt
    to tasks in order and sorted there, so no single task sees the whole order."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = groups.select(*by).repartitionByRange(n, *by).sortWithinPartitions(*by)
    return materialise(ranked.withColumn("next", F.monotonically_increasing_id()), name)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc, key, line, words, label): the places of lines that occur more than once. A line's ID is the
    rank of its 128-bit hash."""
    base = plain(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), row_key().alias("key"), "text")
    lines = (base.select("doc", "key", F.posexplode(F.split("text", "\n", -1)).alias("line", "x"))
             .select(*AT, F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"), _words(F.col("x")).alias("words")))
    twice = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = _labels(twice, ["h", "g"], "line-ids")
    return materialise(lines.join(ids, ["h", "g"]).select(*AT, "words", F.col("next").alias("label")).dropDuplicates(AT), "lines")


def _double(level: DataFrame, span: int) -> DataFrame:
    """Labels of the first 2 * span lines from those of the first ``span``."""
    ahead = W.partitionBy("doc", "key").orderBy("line").rangeBetween(span, span)
    pairs = materialise(level.select(*AT, "label", F.max("label").over(ahead).alias("then")).where("then is not null"), "pairs")
    twice = pairs.groupBy("label", "then").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = _labels(twice, ["label", "then"], "prefixes")
    return materialise(pairs.join(ids, ["label", "then"]).select(*AT, F.col("next").alias("label")), "level")


def least_runs(places: DataFrame, least: int) -> DataFrame:
    """(doc, key, start, end): from every line forwards, and back from every line, the shortest run of
    ``least`` words. Every run of that many words is the union of such runs inside it."""
    up = W.partitionBy("doc", "key").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    c = places.select(*AT, "words", F.sum("words").over(up).alias("c"))
    line = F.col("line")

    def found(value, mark, best, order):
        asks = F.struct(value.alias("v"), F.lit(1).alias("asks"), line.alias("p"))
        marks = F.struct(mark.alias("v"), F.lit(0).alias("asks"), line.alias("p"))
        e = c.select("doc", "key", F.explode(F.array(asks, marks)).alias("m")).select("doc", "key", "m.*")
        w = W.partitionBy("doc", "key").orderBy(order, F.asc("asks")).rowsBetween(W.unboundedPreceding, 0)
        return e.withColumn("other", best(F.when(F.col("asks") == 0, F.col("p"))).over(w)).where("asks = 1 and other is not null")
    ahead = found(F.col("c") - F.col("words") + least, F.col("c"), F.min, F.desc("v")).select("doc", "key", F.col("p").alias("start"), F.col("other").alias("end"))
    back = found(F.col("c") - least, F.col("c") - F.col("words"), F.max, F.asc("v")).select("doc", "key", F.col("other").alias("start"), F.col("p").alias("end"))
    return ahead.union(back).distinct()


def later_copies(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc, key, start, end): the maximal runs of lines that are later copies, that is, made of repeated
    runs of ``least`` words or more that begin at an earlier place (by id, then line) as well."""
    places = repeated_lines(docs)
    level = places.select(*AT, "label")
    j = F.floor(F.log2(F.col("end") - F.col("start") + 1)).cast("int")
    runs = materialise(least_runs(places, least).withColumn("j", j), "runs")
    deepest = runs.agg(F.max("j")).first()[0]
    later, k = None, 0
    while deepest is not None and k <= deepest:
        if k:
            level = _double(level, 1 << (k - 1))
            if level.isEmpty():
                break
        some = runs.where(F.col("j") == k).withColumn("tail", F.col("end") - (1 << k) + 1)
        first = level.select("doc", "key", F.col("line").alias("start"), F.col("label").alias("a"))
        last = level.select("doc", "key", F.col("line").alias("tail"), F.col("label").alias("b"))
        held = materialise(some.join(first, ["doc", "key", "start"]).join(last, ["doc", "key", "tail"])
                           .select("doc", "key", "start", "end", "a", "b", (F.col("end") - F.col("start")).alias("len")), "held")
        place = F.struct("doc", "start", "key")
        groups = held.groupBy("len", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = held.join(groups, ["len", "a", "b"]).where(place != F.col("first")).select("doc", "key", "start", "end")
        later = copies if later is None else later.unionByName(copies)
        k += 1
    if later is None:
        later = runs.select("doc", "key", "start", "end").limit(0)
    by = W.partitionBy("doc", "key").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    islands = (later.withColumn("new", F.when(F.coalesce(F.col("start") > before + 1, F.lit(True)), 1).otherwise(0))
               .withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0))))
    return islands.groupBy("doc", "key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def dedup(docs: DataFrame, least: int = 5) -> DataFrame:
    """``docs`` with text without later copies of repeated line runs, and __runs: the deleted (start, end).

    Null texts stay null and empty texts empty; a text of later copies alone becomes empty; blank lines go
    only as part of a run. Rows that repeat an id and its text are one document and get the same text; rows
    that share an id with another text follow each other in the order of their content keys. Null ids come
    before all others. An empty table gives no rows.
    """
    runs = later_copies(docs, least).groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__runs"))
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__key": row_key()})
    both = keyed.join(runs, (F.col("__doc") == runs["doc"]) & (F.col("__key") == runs["key"]), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists("__runs", lambda r: (i >= r["start"]) & (i <= r["end"])))
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.withColumn("__text", text).select(*[F.col("__text").alias(c) if c == "text" else docs[c] for c in docs.columns], "__runs", F.col("text").alias("__before"))


def report(docs: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_deleted, n_runs, text_sha256), one row per row of ``docs``."""
    d = dedup(plain(docs, "doc_id", "text"), least)
    gone = F.aggregate(F.coalesce("__runs", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)
    return d.select("doc_id", F.coalesce(F.size(F.split("__before", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"),
                    F.when(F.col("__runs").isNull(), 0).otherwise(F.size("__runs")).cast("long").alias("n_runs"), F.sha2("text", 256).alias("text_sha256"))


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM d),
worded AS (SELECT *, CASE WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) = 0 THEN 0 ELSE greatest(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')), length(x) // 24) END AS w FROM lines),
c AS (SELECT doc_id, i, x, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM worded),
spans AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c >= a.c - a.w + 5 GROUP BY 1, 2
  UNION
  SELECT a.doc_id, max(b.i) AS s, a.i AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i <= a.i AND b.c - b.w <= a.c - 5 GROUP BY a.doc_id, a.i),
held AS (SELECT s.doc_id, s.s, s.e, array_to_string(list_slice(d.ls, s.s + 1, s.e + 1), chr(10)) AS body FROM spans s JOIN d USING (doc_id)),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS rn FROM held) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM later),
marked AS (SELECT c.doc_id, c.i, c.x, g.i IS NOT NULL AS gone, lag(g.i IS NOT NULL, 1, false) OVER (PARTITION BY c.doc_id ORDER BY c.i) AS before
           FROM c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.i = g.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted, count(*) FILTER (WHERE gone AND NOT before) AS n_runs,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""
