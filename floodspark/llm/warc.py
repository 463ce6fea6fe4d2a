"""WARC derivatives: metadata and plain-text conversion records of HTTP responses.

Every response gets two records that refer to it (WARC-Refers-To), keep its target address, date and source
headers, and carry digests of their own blocks and of the payload they were made from. Identifiers are
derived from the content, so a repeated task writes the same records. Column expressions only.

Edge cases: a NULL payload is an empty one, a NULL address stays out of the headers; equal responses give
equal records, row for row; markup that is never closed is text up to its last ``<``; an empty table gives
none. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text, tags that end a line, and named character references.
HIDDEN = ("script", "style", "noscript", "template")
BREAKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|title"
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(html: Column) -> Column:
    """Visible text: comments and hidden elements go, block tags end lines, references are resolved."""
    text = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    hidden = "|".join(rf"{name}\b[^>]*>.*?</{name}" for name in HIDDEN)
    text = F.regexp_replace(text, rf"(?is)<(?:{hidden})\s*>", " ")
    # The end tag of the head may be missing; then the body ends it.
    text = F.regexp_replace(text, r"(?is)<head\b[^>]*>.*?(</head\s*>|<body\b)", " $1")
    text = F.regexp_replace(text, rf"(?i)</?({BREAKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for name, character in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(character))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def record_id(*parts: Column) -> Column:
    """A name-based identifier in the form of a UUID."""
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def page_responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Raw pages as responses; the tables name no header and no date, so both are stated here."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n"),
    )
    return pages.select(
        F.col("page_id"), record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), payload).alias("response_id"),
        F.col("url").cast("string").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"),
        payload.alias("payload"),
    )


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record.

    ``responses`` has the key, response_id, target_uri, date, http_headers (lines that end in CRLF) and payload.
    """
    source = responses.select(
        F.col(key).alias("key"), "response_id", "target_uri", "date",
        F.coalesce("http_headers", F.lit("")).alias("http_headers"),
        F.coalesce("payload", F.lit("")).alias("payload"),
    ).withColumns({"payload_digest": digest(F.col("payload")), "text": plain_text(F.col("payload"))})
    about = F.concat(
        F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-payload-length: "),
        F.octet_length("payload").cast("string"), F.lit("\r\nconversion-record: "),
        record_id(F.lit("conversion"), F.col("response_id")), F.lit("\r\nsource-status-and-headers:\r\n"),
        F.col("http_headers"),
    )

    def record(kind: str, content_type: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"), record_id(F.lit(kind), F.col("response_id")).alias("record_id"),
            F.lit(content_type).alias("content_type"), block.alias("block"),
        )

    both = F.explode(F.array(
        record("metadata", "application/warc-fields", about), record("conversion", "text/plain; charset=utf-8", F.col("text")),
    ))
    return source.withColumn("r", both).select(
        F.col("key").alias(key), "r.warc_type", "r.record_id", F.col("response_id").alias("refers_to"), "target_uri",
        "date", "r.content_type", F.octet_length("r.block").cast("bigint").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"), "payload_digest", "http_headers", "r.block",
    )


def serialised() -> Column:
    """A row of ``derivatives`` as the bytes of one WARC 1.1 record; concatenated records are a file."""
    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    address = F.when(F.col("target_uri").isNotNull(), header("WARC-Target-URI", F.col("target_uri"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.col("warc_type")), header("WARC-Record-ID", F.col("record_id")),
        header("WARC-Refers-To", F.col("refers_to")), address, header("WARC-Date", F.col("date")),
        header("WARC-Block-Digest", F.col("block_digest")), header("WARC-Source-Payload-Digest", F.col("payload_digest")),
        header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"),
    ).cast("binary")
