"""WARC archives of pages, and one globally ordered index over them."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Window

from cohortry.llm.common import DataFrame, F, materialise, plain
from cohortry.session import checkpoint_root

ARCHIVE_BYTES = 32 << 20  # payload of one archive; a reader holds one archive at a time
SEGMENT_ROWS = 100_000    # index rows of one merge task
END = "\r\n\r\n"


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, digest, stamp). The table has no capture time, so a page is
    taken ``page_id`` seconds after 2024-01-01; a null id is taken at that moment."""
    p = plain(pages, "page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    at = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id").cast("long"), F.lit(0)))
    return p.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A").alias("url"), html.alias("html"),
                    F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("digest"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


def write_archives(pages: DataFrame, least: int = 100) -> str:
    """Write one WARC record per page and return the archives' folder.

    Records with equal payloads of ``least`` bytes or more: the smallest id carries the payload, the
    others are revisits of it; a page without an id always carries its payload. Spark's text writer makes the files, with the blank lines that end a record
    as line separator, so a lost task is written again and the files land in the shared folder.
    """
    spark = pages.sparkSession
    seen = captures(pages)
    light = seen.select("page_id", "payload_bytes", "digest")
    first = (light.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 and first is not null").select("digest", "first"))
    files = max(1, -(-(light.agg(F.sum("payload_bytes")).first()[0] or 0) // ARCHIVE_BYTES))
    files = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))  # with fewer, Spark would deal the pages out again
    again = (light.join(first, "digest").where(F.col("page_id") > F.col("first")).groupBy(F.col("page_id").alias("_p"))
             .agg(F.collect_set(F.struct("digest", "first")).alias("_again")))  # one entry but for ids with several payloads
    seen = seen.withColumn("_k", F.coalesce("page_id", F.xxhash64("url", "digest")))  # pages without an id are spread by what they hold
    rows = (seen.repartition(files, "_k").join(again.repartition(files, "_p").hint("shuffle_hash"), F.col("_k") == F.col("_p"), "left")
            .withColumn("first", F.get(F.filter("_again", lambda x: x["digest"] == F.col("digest")), 0)["first"]))
    old = F.col("first").isNotNull() & F.col("page_id").isNotNull()
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(old, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), "url"), F.concat(F.lit("WARC-Date: "), "stamp"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(old, F.concat_ws("\r\n", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">")),
                                F.concat(F.lit("WARC-Refers-To-Payload-Length: "), F.col("payload_bytes").cast("string")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(old, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")))
    record = F.concat(head, F.lit(END), F.when(old, F.lit("")).otherwise(F.col("html")))
    folder = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)
    return folder


def records(data: bytes):
    """(header fields, payload, offset) of every record of an archive. A record is as long as it says, so
    its payload may hold anything."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        lines = data[at:split].decode("utf-8").split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = split + 4
        end = start + int(fields["Content-Length"])
        yield fields, data[start:end], at
        at = end + 4


_URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", re.I)


def url_key(url: str) -> str:
    """Host turned round, then path and query: captures of a host and of a path lie side by side."""
    m = _URL.match(url)
    if not m:
        return url.lower()
    host = m[1].lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){(m[2] or '/').lower()}"


_RUN = "run string, seq long, url_key string, stamp string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, at long"
_KINDS = [("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
          ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("at", pa.int64())]


def _number(urn: str) -> int | None:
    digits = urn[len("<urn:page:"):-1]
    return int(digits) if digits else None


def capture_runs(spark, folder: str) -> DataFrame:
    """Index rows of the archives. Each archive is one run, sorted by URL key, time and id; digest and
    length of a response come from the payload read, those of a revisit from what it refers to."""
    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                run, rows = path.as_py().rsplit("/", 1)[-1], []
                for f, payload, at in records(gzip.decompress(content.as_py())):
                    old = f["WARC-Type"] == "revisit"
                    rows.append((url_key(f["WARC-Target-URI"]), f["WARC-Date"], _number(f["WARC-Record-ID"]), f["WARC-Type"], _number(f["WARC-Refers-To"]) if old else None,
                                 int(f["WARC-Refers-To-Payload-Length"]) if old else len(payload),
                                 f["WARC-Payload-Digest"].removeprefix("sha256:") if old else hashlib.sha256(payload).hexdigest(), at))
                rows.sort(key=_order)
                made = [(run, i, *r) for i, r in enumerate(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInArrow(read, _RUN)


def _order(row: tuple) -> tuple:
    key, stamp, page = row[:3]
    return key, stamp, page is not None, page or 0


class LoserTree:
    """Merges k sorted runs: an inner node keeps the loser of its match, so the next smallest head costs one
    walk from its leaf to the root."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] == -1:  # while the tree fills, the first to arrive waits for its match
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (head := self._head(self.losers[0])) is not None:
            yield head
            self.at[self.losers[0]] += 1
            self._play(self.losers[0])


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs in one global order by URL key, time and id, with ``place``, a row's number in that order from 1.

    Key ranges are dealt to tasks by all three, so one URL with a third of all captures is spread as well;
    a task merges the pieces of the sorted runs that fall into its range.
    """
    spark = runs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // SEGMENT_ROWS))
    dealt = runs.repartitionByRange(tasks, "url_key", "stamp", "page_id").sortWithinPartitions("run", "seq")

    def merge(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        names, keys, parts = rows.column("run").to_pylist(), [rows.column(c).to_pylist() for c in ("url_key", "stamp", "page_id")], []
        for i, name in enumerate(names):
            if not i or name != names[i - 1]:
                parts.append([])
            parts[-1].append((_order((keys[0][i], keys[1][i], keys[2][i])), i))
        yield from rows.take([i for _, i in LoserTree(parts)]).combine_chunks().to_batches()
    merged = materialise(dealt.mapInArrow(merge, runs.schema).withColumn("_at", F.monotonically_increasing_id()), "merged")  # the task in the high bits
    task, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = merged.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("task").alias("_t"), F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per task
    return merged.join(before, task == F.col("_t")).withColumn("place", F.col("_before") + row + 1).drop("_at", "_t", "_before")


def histories(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and merge their runs. One row per page; null html is an empty
    payload, null URLs are empty, repeated rows of one page are all kept as they are, an empty table gives
    no rows."""
    folder = write_archives(pages)
    return merge_runs(materialise(capture_runs(pages.sparkSession, folder), "runs"))
