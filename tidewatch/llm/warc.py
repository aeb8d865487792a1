"""WARC derivatives: linked metadata and plain-text conversion records made from response records.

Every derivative names the response that it refers to, with that record's target, date and payload digest,
and carries digests of its own block. The metadata record lists the source's HTTP headers and what the page
says of itself; the conversion record holds its plain text. Identifiers follow from content, so a job that
runs again makes the same ones.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from functools import reduce
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.token_files import _place

#: Elements whose content is no text, and elements that begin a line. What is not closed ends with the page, as HTML
#: has it, so no pattern fails after a long way and each page takes linear time.
HIDDEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    r"|<script\b[^>]*(?:>.*?(?:</script\s*>|\z)|\z)|<style\b[^>]*(?:>.*?(?:</style\s*>|\z)|\z)"
)
LINES = (
    r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|tr|td|th|table|article|section|header|footer|nav|title|head|body|blockquote|pre)"
    r"\b[^>]*(?:>|\z)"
)
TAGS = r"<[a-zA-Z/!?][^>]*(?:>|\z)"
#: A title that is not closed is none.
TITLE = r"(?is)<title\b[^>]*(?:>(?:(.*?)</title\s*>|.*)|\z)"
#: Usual named characters and what plain text has for them; & comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
#: References to characters, by number or name. Names that HTML does not know stay as they are.
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
#: What HTML reads in place of the numbers 128 to 159.
REPLACED = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)]
#: The given tables don't say when a page was fetched.
DATE = "2024-01-01T00:00:00Z"


def _attribute(tag: str, name: str, loose: str) -> str:
    """An expression for an attribute's value, in quotes of either kind or bare.

    Other attributes are passed over whole, up to the next tag. Where a tag is not well formed, `loose` leads to a value in double quotes.
    """
    other = rf"""[\s/]++(?!{name}[\s=])[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'<>][^\s<>]*+))?+"""
    return rf"""(?i)<{tag}(?:(?:{other})*+[\s/]+{name}\s*=\s*|{loose}{name}=(?="))("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


LINK = _attribute("a", "href", r"\s[^<>]*?")
LANG = _attribute("html", "lang", r"[^<>]*?\s")


def _unquoted(value: Column) -> Column:
    return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def _character(reference: Column) -> Column:
    """The character that a reference stands for; a reference that means nothing as it is."""
    usual = reduce(lambda other, e: F.when(reference == e[0], e[1]).otherwise(other), ENTITIES, F.lit(None).cast("string"))
    names = {f"&{n}": c for n, c in html5.items() if n.endswith(";")}
    named = F.try_element_at(F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in names.items())), F.lit("\x01"), F.lit("\x02")), reference)
    hexadecimal = F.conv(F.regexp_extract(reference, "^&#[xX](.*);$", 1), 16, 10)
    digits = F.when(reference.rlike("^&#[xX]"), hexadecimal).otherwise(F.regexp_extract(reference, "^&#(.*);$", 1))
    number = F.coalesce(digits.try_cast("long"), F.lit(0))
    bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    sign = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    listed = F.array(*map(F.lit, REPLACED))
    sign = F.when(number == 160, " ").when(number.between(128, 159), F.get(listed, (number - 128).cast("int"))).otherwise(sign)
    return F.coalesce(usual, F.when(reference.startswith("&#"), sign).otherwise(named), reference)


def _unescaped(text: str) -> Column:
    """A text column with each reference, as it was written, replaced once."""
    parts, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(F.col(text), F.lit(REFERENCE), F.lit(0))
    signs = F.concat(F.transform(found, _character), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(parts, signs, lambda p, c: F.concat(p, c)), "")
    return F.when(F.col(text).contains("&"), joined).otherwise(F.col(text))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def identifier(*parts: Column) -> Column:
    """A record's identifier from what makes it the record it is."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str | Column = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html): page_id, record_id, target_uri, date, http_headers,
    payload and payload_digest. `date` is when they were fetched: one text for all, or a text column of `pages`.
    A null url or page is empty; only these columns are read."""
    rows = pages.select(
        F.lit(date).alias("date"),
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_digest", digest(F.col("payload")))
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return rows.select(
        "page_id",
        identifier(F.lit("response"), number, F.col("target_uri"), F.col("payload_digest")).alias("record_id"),
        "target_uri",
        "date",
        head.alias("http_headers"),
        "payload",
        "payload_digest",
    )


def plain_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """Adds the text of a page: a line for each block, single spaces, no markup."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " ")
    rows = rows.withColumn(name, F.regexp_replace(F.regexp_replace(text, LINES, "\n"), TAGS, ""))
    text = F.regexp_replace(F.regexp_replace(_unescaped(name), " +", " "), " ?\n[ \n]*", "\n")
    return rows.withColumn(name, F.btrim(text, F.lit(" \n")))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response, as from `responses`: its metadata and its conversion.

    Columns: page_id, warc_type, record_id, refers_to, concurrent_to (the other derivative), target_uri,
    date, content_type, block, block_digest and source_payload_digest. An empty page gives an empty text and a
    metadata record without title and links; repeated rows give equal records; no response, no derivatives.
    """
    named = lambda kind: identifier(F.lit(kind), F.col("record_id"))
    title = F.regexp_extract("payload", TITLE, 1)
    lang = _unquoted(F.regexp_extract("payload", LANG, 1))
    links = F.array_join(
        F.transform(F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), _unquoted(x), F.lit("\r\n"))), ""
    )
    field = lambda name, value: F.when(value == "", "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    about = F.concat(
        field("source-payload-digest", F.col("payload_digest")),
        F.regexp_replace("http_headers", r"(?m)^(?=[^\r\n])", "source-http-header: "),
        field("language", lang),
        field("title", F.regexp_replace(title, r"[\r\n]+", " ")),
        links,
    )
    rows = records.select("*", named("metadata").alias("_m"), named("conversion").alias("_c"))
    rows = plain_text(rows.withColumn("_about", about), "payload", "_text")
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("_m").alias("id"), F.col("_c").alias("other"),
                 F.lit("application/warc-fields").alias("kind"), F.col("_about").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("_c").alias("id"), F.col("_m").alias("other"),
                 F.lit("text/plain; charset=utf-8").alias("kind"), F.col("_text").alias("block")),
    )
    rows = rows.select("page_id", "record_id", "target_uri", "date", "payload_digest", F.explode(made).alias("one"))
    return rows.select(
        "page_id",
        "one.warc_type",
        F.col("one.id").alias("record_id"),
        F.col("record_id").alias("refers_to"),
        F.col("one.other").alias("concurrent_to"),
        "target_uri",
        "date",
        F.col("one.kind").alias("content_type"),
        "one.block",
        digest(F.col("one.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
    )


def as_record(row: dict) -> bytes:
    """A derivative as it stands in a WARC file."""
    block = row["block"].encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['warc_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Refers-To: {row['refers_to']}",
        f"WARC-Refers-To-Target-URI: {row['target_uri']}",
        f"WARC-Refers-To-Date: {row['date']}",
        f"WARC-Concurrent-To: {row['concurrent_to']}",
        f"WARC-Target-URI: {row['target_uri']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Block-Digest: {row['block_digest']}",
        f"Content-Type: {row['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes derivatives to .warc.gz files below `folder`, one member each: record_id, file, start, length.

    Each attempt of a task writes a file of its own; rows come from attempts that ended well. The result is
    made as it is read, so write it down before it is used twice.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        stream, start = None, 0
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            placed = []
            for row in batch.to_pylist():
                if stream is None:
                    store.create_dir(top, recursive=True)
                    # records are compressed one by one, so the file's own name must not compress it again
                    stream = store.open_output_stream(f"{top}/{name}", compression=None)
                member = gzip.compress(as_record(row), mtime=0)
                stream.write(member)
                placed.append((row["record_id"], name, start, len(member)))
                start += len(member)
            columns = list(zip(*placed)) or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["record_id", "file", "start", "length"])
        if stream is not None:
            stream.close()

    return records.mapInArrow(parts, "record_id string, file string, start long, length long")
