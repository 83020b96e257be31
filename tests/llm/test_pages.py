import random
import re
import time
from html import unescape

import duckdb
import pytest

from cohortry.llm import html, queries, warc
from cohortry.llm.common import F, T

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("run", T.StringType())])
BODY = "<article><p>" + "payload with\r\n\r\nWARC/1.0\r\nblank lines &amp; more " * 5 + "</p></article>"


def pages(spark):
    return spark.createDataFrame([(3, "http://b.example.org/x", BODY, "r"), (1, "https://www.a.example.org/y?q=1#f", BODY, "r"), (2, None, "<p>short</p>", "r"), (4, "http://b.example.org/x", "<p>short</p>", "r"),
                                  (5, "no url\r\nat all", None, "r"), (6, "http://a.example.org", "", "r"), (7, "http://ä.example.org/", "é" * 200_000, "r"), (7, "http://ä.example.org/", "é" * 200_000, "r")], PAGES)


def test_warc_cases(spark):
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.histories(pages(spark)).collect()}
    n = len(BODY.encode())
    assert got == {(1, "response", None, n), (3, "revisit", 1, n), (2, "response", None, 12), (4, "response", None, 12), (5, "response", None, 0), (6, "response", None, 0), (7, "response", None, 400_000)}
    assert warc.histories(pages(spark)).count() == 8
    assert warc.histories(pages(spark).limit(0)).count() == 0


def test_warc_payloads_come_back(spark):
    folder = warc.write_archives(pages(spark))
    import gzip
    held = [(f, p) for path, content in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content").collect() for f, p, _ in warc.records(gzip.decompress(bytes(content)))]
    assert len(held) == 8
    payload = {f["WARC-Record-ID"]: p for f, p in held}
    assert payload["<urn:page:1>"] == BODY.encode() and payload["<urn:page:3>"] == b"" and payload["<urn:page:7>"] == ("é" * 200_000).encode()


def test_index_is_globally_ordered_and_equals_sql(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    rows = warc.histories(table).orderBy("place").collect()
    order = [(r.url_key, r.stamp, r.page_id) for r in rows]
    assert order == sorted(order) and len(rows) == table.count()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    want = con.sql(queries.SQL["op5_warc_index_merge"]).fetchall()
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key, r.stamp, r.place)) for r in rows)
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(30), i) for i in range(rng.randrange(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_main_text_equals_the_article(spark, sf):
    for r in html.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("p"), "html"), F.col("page_id") == F.col("p")).collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_without_article():
    text = "A paragraph that is long enough to be the body of this page, as bodies go, and then some more."
    page = f"<ul class='menu'><li><a href=/>Home</a></li></ul><div><h2>Title</h2><p>{text}</p><p>End.</p></div><div id='comments'><p>{text}</p></div><footer>Small print</footer>"
    assert html.main_text(page) == f"Title\n\n{text}\n\nEnd."
    assert html.main_text("<article><p>a&nbsp;&lt;b&gt;<form>no</form><p>c <i>d</i><div class='ad'>buy</div><p>e</article><aside>f</aside>") == "a <b>\n\nc d\n\ne"
    assert html.main_text("") == html.main_text("<script>x") == html.main_text("<nav>only</nav>") == ""
    assert html.main_text("plain") == "plain"


def test_extract_cases(spark):
    got = html.extract(pages(spark))
    assert got.count() == 8 and {r.page_id for r in got.where("n_chars = 0").collect()} == {5, 6}
    assert html.extract(pages(spark).limit(0)).count() == 0


def test_head_without_its_end():
    for head in ("<head>", "<head class='nav'>", "<head hidden>"):
        assert html.main_text(f"<html>{head}<meta charset=utf-8><title>No</title><style>p</style><body><p>Some text</p>") == "Some text"
        assert html.main_text(f"<html>{head}<title>No</title><p>Some text</p>") == "Some text"
    assert html.main_text("<html><head><title>No</title><script>x()</script></head><body><p>Some text</p></body>") == "Some text"


def test_short_stretches_stay_inside_the_text():
    text = "A paragraph that is long enough to be the body of this page, as bodies go, and then some more."
    page = (f"<div>Skip</div><div class='ad'>buy</div><p>{text}</p><p><a href=/x>All of it a link</a></p><div class='notice'>no</div><p>Short.</p><aside>no</aside>"
            f"<p>{text}</p><figure><figcaption>A caption</figcaption></figure><div class='ad'>buy</div><p>The end.</p><ul class='menu'><li>no</ul><p><a href=/y>More</a></p>")
    assert html.main_text(page) == "\n\n".join([text, "All of it a link", "Short.", text, "A caption", "The end."])
    assert html.main_text("<p>One.</p><aside>no</aside><p>Two words.</p>") == "One.\n\nTwo words."
    assert html.main_text("<article><p>a<figure><figcaption>b</figcaption></figure></article><p>no") == "a\n\nb"


@pytest.mark.parametrize("page, want", [
    ("<article><p class=notice>Ad<p>Real text here</article>", "Real text here"), ("<ul><li class='share'>Share<li>Real text</ul>", "Real text"),
    ("<article><section class=\"related-work\">One</section><div id='notice-of-intent'>Two</div></article>", "One\n\nTwo"),
    ("<main><article>Main</article></main><article>Teaser</article>", "Main"), ("<article>Body<article class='comment'>reader</article></article>", "Body"),
    ("<article><p>before <span class=ad>buy</span> after</p></article>", "before after"), ("<article><p title=it's>one</p><p>it's</p></article>", "one\n\nit's"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><dl><dt>x<dd>y</dl></article>", "a\n\nb\n\nc\n\nx\n\ny"), ("a < b and <a <a", "a < b and <a <a"), ("<p>a</i></b>b", "ab"), ("<script>x", ""), ("<!-- <p>never", "")])
def test_markup_as_browsers_take_it(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize("unit", ["<a ", '<a b="', "<li>", "<!--", "<", "<script>", "</b>", "<x y='", "<p><div>", "<td><li>"])
def test_unclosed_markup_costs_no_more_than_its_length(unit):
    def seconds(n):
        page = unit * (n // len(unit))
        start = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - start
    assert seconds(1_000_000) < 30 * max(seconds(100_000), 0.02)
