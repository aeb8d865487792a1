"""WARC derivatives against SQL, and written files as a round trip."""

from __future__ import annotations

import gzip
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from checks.compare import database, differences

from tidewatch.llm import oracles, queries, warc

PAGE = (
    '<html lang="de"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One  two<br>three'
    '<script>var t="</p>";</script> <b>four</b></p><a href="/x">five</a> &lt;six&gt;</body></html>'
)


def test_query_equals_sql(spark, folder):
    assert differences(spark, database(folder), folder, queries.op7_warc_derivatives, oracles.WARC) == []


def test_text_links_and_digests(spark):
    rows = spark.createDataFrame(
        [(1, "http://a/", PAGE, "x"), (2, None, None, "x"), (None, "http://b/", "", "x"), (1, "http://a/", PAGE, "x"), (3, "u", "plain", "x")],
        "page_id long, url string, html string, record_id string",
    )
    got = warc.derivatives(warc.responses(rows)).collect()
    assert len(got) == 10
    texts = {r.page_id: r.block for r in got if r.warc_type == "conversion"}
    assert texts[1] == "A & B\nOne two\nthree four\nfive <six>"
    assert (texts[2], texts[None], texts[3]) == ("", "", "plain")
    facts = {r.page_id: r.block for r in got if r.warc_type == "metadata"}
    assert "title: A &amp; B\r\n" in facts[1] and "outlink: /x\r\n" in facts[1] and "language: de\r\n" in facts[1]
    assert "source-http-header: Content-Type: text/html; charset=utf-8\r\n" in facts[1]
    ids = {(r.page_id, r.warc_type): r for r in got}
    for r in got:
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        other = ids[r.page_id, "metadata" if r.warc_type == "conversion" else "conversion"]
        assert r.concurrent_to == other.record_id and r.refers_to == other.refers_to != r.record_id
    empty = warc.derivatives(warc.responses(rows.limit(0)))
    assert empty.collect() == []


def test_links_in_any_quotes_and_references_of_any_kind(spark):
    page = (
        "<html class=x lang='fr'><body><a href='/one'>1</a><a class=b href=/two/>2</a><A title=\"href=no\" HREF = \"/three\">3</A>"
        "<a data-href='/no' href=/four>4</a><a name=x>5</a>"
        "<p>caf&#233; it&#x27;s &eacute;&hellip;&euro; &#128512; &#150; &#38;lt; &amp;#65; &amp;lt; &nosuch; &#0; R&D &Tab;x&#160;y</p></body></html>"
    )
    bare = "<html lang=it><a href=x>y</a>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", bare)], "page_id long, url string, html string")
    got = {(r.page_id, r.warc_type): r.block for r in warc.derivatives(warc.responses(rows)).collect()}
    assert re.findall("outlink: (.*)\r\n", got[1, "metadata"]) == ["/one", "/two/", "/three", "/four"]
    assert "language: fr\r\n" in got[1, "metadata"]
    assert "language: it\r\noutlink: x\r\n" in got[2, "metadata"]
    assert got[1, "conversion"].split("\n")[-1] == "café it's é…€ 😀 – &lt; &#65; &lt; &nosuch; \ufffd R&D \tx y"


@pytest.mark.parametrize(
    "piece",
    [" ", "\n", "<!--", "<!-- -", "<script>", "<script ", "<style>", "<title>", "<title ", "<a ", "<a x=", "<a href='", "<p", "</script ", "&", "&#1", "<html "],
)
def test_pages_full_of_openings_take_linear_time(spark, piece):
    page = "<p>one</p>" + piece * (1_000_000 // len(piece))
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    start = time.perf_counter()
    got = {r.warc_type: r.block for r in warc.derivatives(warc.responses(rows)).collect()}
    assert time.perf_counter() - start < 4
    assert got["conversion"].startswith("one")


def test_what_is_not_closed_ends_with_the_page(spark):
    pages = {
        "a<!-- b <p>c": "a", "a<!-->b<!--->c<!-- x --!>d": "abcd", "a<script x='1'>b</p>": "a", "a<style>b": "a", "a<script b": "a",
        "a<!-- <script> -->b<script>c</script >d": "abd", "a <b": "a", "1 < 2 <p>x": "1 < 2\nx", "<title>t": "t",
    }
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    made = warc.derivatives(warc.responses(rows, F.concat(F.lit("at "), F.col("page_id").cast("string")))).collect()
    assert {r.page_id: r.block for r in made if r.warc_type == "conversion"} == dict(enumerate(pages.values()))
    assert all(r.date == f"at {r.page_id}" for r in made)
    assert not any("title: " in r.block for r in made if r.warc_type == "metadata")


def test_files_hold_every_record(spark, folder, tmp_path):
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{folder}/pages.parquet")))
    placed = warc.write(made, str(tmp_path / "warc")).collect()
    rows = {r.record_id: r.asDict() for r in made.collect()}
    assert len(placed) == len(rows)
    for p in placed:
        data = (tmp_path / "warc" / p.file).read_bytes()[p.start : p.start + p.length]
        record = gzip.decompress(data)
        assert record == warc.as_record(rows[p.record_id])
        assert re.search(rb"WARC-Refers-To: (\S+)", record)[1].decode() == rows[p.record_id]["refers_to"]
