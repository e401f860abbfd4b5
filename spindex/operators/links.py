"""Pages, outlinks and the link graph.

parse -> text/hrefs (Arrow UDF, narrow) -> empty-text filter -> outlinks
(posexplode, native filter, native/UDF resolution).  Storing pages, stubs and
edges is the ingest plan's work (``plans.ingest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.html import parse_html
from spindex.functions.urls import keep_outlink, resolve_outlink


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Captured pages with ``html`` replaced by ``text`` and ``hrefs``; other
    columns pass through, the URL column is named ``url``."""
    keep = [F.col(c).alias("url") if c == url_col else F.col(c)
            for c in pages.columns if c != html_col]
    parsed = pages.select(*keep, parse_html(html_col).alias("_p"))
    return parsed.select(*[c for c in parsed.columns if c != "_p"],
                         F.col("_p.text").alias("text"), F.col("_p.hrefs").alias("hrefs"))


def page_text(parsed: DataFrame) -> DataFrame:
    """Pages whose text is not empty (empty pages are not stored and their
    links are not followed)."""
    return parsed.where(F.length("text") > 0)


def corpus_from_parsed(parsed: DataFrame) -> DataFrame:
    """Search corpus ``(page_id, page_url, page_content)`` from parsed pages."""
    return page_text(parsed).select("page_id", F.col("url").alias("page_url"),
                                    F.col("text").alias("page_content"))


def raw_outlinks(parsed: DataFrame) -> DataFrame:
    """Every href in document order: ``(page_id, url, pos, href)``; pages
    with empty text contribute none."""
    return page_text(parsed).select("page_id", "url", F.posexplode("hrefs").alias("pos", "href"))


def resolved_outlinks(parsed: DataFrame, emit_links=None) -> DataFrame:
    """Kept and resolved outlinks ``(page_id, url, pos, href, outlink)``.

    ``emit_links`` (optional boolean Column over ``parsed``) turns link
    emission off per page (crawl budget passed).
    """
    src = page_text(parsed)
    if emit_links is not None:
        src = src.where(emit_links)
    raw = src.select("page_id", "url", F.posexplode("hrefs").alias("pos", "href"))
    kept = raw.where(keep_outlink("href"))
    return kept.withColumn("outlink", resolve_outlink("url", "href")).where(F.col("outlink").isNotNull())


def outlink_lists(parsed: DataFrame, emit_links=None) -> DataFrame:
    """``(url, text, outlinks ARRAY<STRING>)`` — the parsed-page record."""
    links = resolved_outlinks(parsed, emit_links)
    lists = links.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "outlink"))), lambda s: s["outlink"])
        .alias("outlinks"))
    return (page_text(parsed).join(lists, "page_id", "left")
            .select("page_id", "url", "text",
                    F.coalesce("outlinks", F.array().cast("array<string>")).alias("outlinks")))


# --- batches and edges ------------------------------------------------------------

EDGES_SCHEMA = "source_page_id BIGINT, outgoing_page_id BIGINT"


def last_per_url(records: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Last record per URL inside a batch (highest ``seq`` wins)."""
    cols = [c for c in records.columns if c != "url"]
    best = records.groupBy("url").agg(F.max_by(F.struct(*cols), F.col(seq_col)).alias("r"))
    return best.select("url", *[F.col(f"r.{c}").alias(c) for c in cols])


def _neighbours(edges: DataFrame, pages: DataFrame, me: str, other: str) -> DataFrame:
    e = edges.select(F.col(me).alias("page_id"), F.col(other).alias("neighbour_id"))
    p = pages.select("page_id", "page_url")
    n = pages.select(F.col("page_id").alias("neighbour_id"), F.col("page_url").alias("neighbour_url"))
    return e.join(p, "page_id").join(n, "neighbour_id") \
        .select("page_id", "page_url", "neighbour_id", "neighbour_url")


def neighbours_out(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """``(page_id, page_url, neighbour_id, neighbour_url)`` along outlinks."""
    return _neighbours(edges, pages, "source_page_id", "outgoing_page_id")


def neighbours_in(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """``(page_id, page_url, neighbour_id, neighbour_url)`` along inlinks."""
    return _neighbours(edges, pages, "outgoing_page_id", "source_page_id")
