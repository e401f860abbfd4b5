"""Captured fetch responses.

Fetching is outside Spark; a crawl round hands over a table of responses
``(url, ok, status, headers MAP<STRING,STRING>, text, received, fetched_at)``.
``captured_responses`` derives such a table from the driver's ``pages``
(deterministic rules on ``page_id``) so every header case occurs: missing,
empty, upper-case names, values at and over the size limit, malformed
lengths, foreign languages, non-HTML types, retry hints as seconds, dates
and junk, and responses that never arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.timeutil import utc_instant

RESPONSES_SCHEMA = ("url STRING, ok BOOLEAN, status INT, headers MAP<STRING,STRING>, "
                    "text STRING, received BOOLEAN, fetched_at TIMESTAMP, seq BIGINT")

EPOCH = "2024-01-01 00:00:00"
RETRY_DATE = "Wed, 21 Oct 2026 07:28:00 GMT"


def _pick(key, mod, values):
    """values[key % mod] as a CASE expression (None = header missing)."""
    m = F.pmod(F.col(key), F.lit(mod))
    expr = None
    for i, v in enumerate(values):
        val = F.lit(v).cast("string") if not isinstance(v, F.Column) else v
        expr = F.when(m == i, val) if expr is None else expr.when(m == i, val)
    return expr


def fixture_columns(pages: DataFrame) -> DataFrame:
    """Header values and status per page (columns used by both the response
    table and its SQL twin)."""
    pid = F.col("page_id")
    status = (F.when(F.pmod(pid, F.lit(17)) == 0, F.lit(429))
              .when(F.pmod(pid, F.lit(13)) == 0, F.lit(404)).otherwise(F.lit(200)))
    extra = ["seq"] if "seq" in pages.columns else []
    seq = F.col("seq") if extra else pid
    return pages.select(
        "page_id", "url", "html", *extra,
        status.alias("status"),
        (F.pmod(pid, F.lit(19)) != 0).alias("received"),
        _pick("page_id", 5, [None, "application/pdf", "TEXT/HTML", "text/html; charset=utf-8",
                             "text/html; charset=utf-8"]).alias("content_type"),
        _pick("page_id", 7, [None, "fr", "", "en-US", "en-US", "en-US", "en-US"]).alias("content_language"),
        _pick("page_id", 11, ["3145728", "3145729", "abc"] +
              [F.length("html").cast("string")] * 8).alias("content_length"),
        _pick("page_id", 4, [None, "120", RETRY_DATE, "soon"]).alias("retry_after"),
        (F.pmod(pid, F.lit(3)) == 0).alias("lower_names"),
        F.timestamp_micros(F.unix_micros(utc_instant(EPOCH)) + seq * F.lit(1_000_000))
        .alias("fetched_at"),
    )


def captured_responses(pages: DataFrame) -> DataFrame:
    f = fixture_columns(pages)

    def name(n):
        return F.when(F.col("lower_names"), F.lit(n.lower())).otherwise(F.lit(n))

    entries = F.array(
        F.struct(name("Content-Type").alias("key"), F.col("content_type").alias("value")),
        F.struct(name("Content-Language").alias("key"), F.col("content_language").alias("value")),
        F.struct(name("Content-Length").alias("key"), F.col("content_length").alias("value")),
        F.struct(name("Retry-After").alias("key"), F.col("retry_after").alias("value")),
    )
    headers = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    got = F.col("received")
    return f.select(
        "url",
        F.when(got, F.col("status") < 400).alias("ok"),
        F.when(got, F.col("status")).cast("int").alias("status"),
        F.when(got, headers).alias("headers"),
        F.when(got, F.col("html")).alias("text"),
        got.alias("received"),
        F.col("fetched_at"),
        (F.col("seq") if "seq" in f.columns else F.col("page_id")).alias("seq"),
    )


def recrawl_pages(pages: DataFrame) -> DataFrame:
    """Second visit of every page whose URL has a query string: navigation
    links gone (fewer outlinks), one paragraph added, a later ``seq``.  A
    stale copy with the old HTML is in the same batch, earlier in ``seq``,
    so the last record per URL must win."""
    revisited = pages.where(F.col("url").contains("?"))
    new_html = F.replace(F.regexp_replace("html", r"(?s)<nav>.*?</nav>", ""),
                         F.lit("</article>"), F.lit("<p>Second visit.</p></article>"))
    fresh = revisited.select("page_id", "url", new_html.alias("html"),
                             (F.col("page_id") + 1_000_000).alias("seq"))
    stale = revisited.select("page_id", "url", "html", (F.col("page_id") + 500_000).alias("seq"))
    return fresh.unionByName(stale)


def recrawl_responses(pages: DataFrame) -> DataFrame:
    return captured_responses(recrawl_pages(pages))
