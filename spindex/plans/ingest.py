"""Ingest of captured responses into the pages table and the link graph.

responses -> received -> header rules -> parse (text, hrefs) -> non-empty
text -> last record per URL -> outlinks (filter, resolve; none once the crawl
budget is spent) -> ids of all URLs -> contents and edges appended.

The graph is four append-only tables (``sources.log_table``), so a batch writes
what it brings:

``urls``      ``id, key``: the dictionary (``operators.dictionary``).  New URLs get the next dense
              ids in URL order, after those of all batches before; no two URLs
              can meet in an id.
``contents``  ``page_id, page_content, batch``: of a page the newest counts.  A
              URL without content is a stub (a link target never fetched).
``edges``     ``source_page_id, outgoing_page_id, batch``: added once, never
              removed, unless a batch is told to ``replace_links``: a row without
              a target then ends the links that a re-crawled page had before.
``batches``   what each batch brought, and the positions to carry on from.

Stored tables are scanned and probed by the batch (``operators.joins``), never
rewritten; ``compact`` merges their runs by size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.operators import links as lk
from spindex.operators.dictionary import Dictionary, new_dictionary
from spindex.operators.joins import missing_from
from spindex.operators.ordering import with_global_position
from spindex.operators.responses import decode_body, good_responses
from spindex.session import at_once
from spindex.session import materialize as write_once
from spindex.sources.log_table import LogTable

BATCHES_SCHEMA = ("pages_stored BIGINT, stubs_added BIGINT, edges_added BIGINT, next_id BIGINT, fetched BIGINT, "
                  "replaced BOOLEAN, batch BIGINT")


@dataclass(frozen=True)
class LinkGraph:
    """The graph as it is before batch ``batch`` (what later batches add does not show)."""

    spark: SparkSession
    folder: str
    batch: int = 0
    last: tuple[int, int, bool] | None = None  # carried from the batch before; read from ``batches`` if not given

    @property
    def dictionary(self) -> Dictionary:
        return new_dictionary(self.spark, "urls", f"{self.folder}/urls")

    @property
    def urls(self) -> LogTable:
        return self.dictionary.log

    @property
    def contents(self) -> LogTable:
        return LogTable(self.spark, f"{self.folder}/contents", "page_id BIGINT, page_content STRING, batch BIGINT", "page_id", newest="batch")

    @property
    def links(self) -> LogTable:
        return LogTable(self.spark, f"{self.folder}/edges", f"{lk.EDGES_SCHEMA}, batch BIGINT", "source_page_id")

    @property
    def batches(self) -> LogTable:
        return LogTable(self.spark, f"{self.folder}/batches", BATCHES_SCHEMA, "batch", buckets=1)

    @property
    def pages(self) -> DataFrame:
        """``page_id, page_url, page_content`` (null content: a stub)."""
        texts = self.contents.current(self.batch).select("page_id", "page_content")
        urls = self.urls.rows(self.batch).select(F.col("id").alias("page_id"), F.col("key").alias("page_url"))
        return urls.join(texts, "page_id", "left").select("page_id", "page_url", "page_content")

    @property
    def edges(self) -> DataFrame:
        """``source_page_id, outgoing_page_id``; of sources whose links a batch replaced, those of the last such batch on."""
        rows = self.links.rows(self.batch)
        if not self.carried()[2]:
            return rows.drop("batch")
        since = rows.where("outgoing_page_id IS NULL").groupBy("source_page_id").agg(F.max("batch").alias("since"))
        return rows.where("outgoing_page_id IS NOT NULL").join(since, "source_page_id", "left") \
            .where(F.col("since").isNull() | (F.col("batch") >= F.col("since"))) \
            .select("source_page_id", "outgoing_page_id").distinct()

    def carried(self) -> tuple[int, int, bool]:
        """After the batches so far: the next id, the number of pages fetched, and whether links were ever replaced."""
        if self.last is not None:
            return self.last
        if not self.batches.runs(self.batch):
            return 0, 0, False
        r = self.batches.rows(self.batch).agg(F.max("next_id"), F.max("fetched"), F.max("replaced")).first()
        return r[0], r[1], r[2]


def empty_graph(spark: SparkSession, folder: str | None = None) -> LinkGraph:
    """A graph without pages, kept in ``folder`` (a new one under the checkpoint folder by default)."""
    from spindex.streaming.state import scratch_dir
    return LinkGraph(spark, folder or scratch_dir(spark, "graph"))


def graph_of(pages: DataFrame, edges: DataFrame, folder: str | None = None) -> LinkGraph:
    """Existing tables (``page_id, page_url, page_content`` with their ids, and edges) as batch 0 of a graph."""
    g = empty_graph(pages.sparkSession, folder)
    g.urls.append(pages.select(F.col("page_id").alias("id"), F.col("page_url").alias("key")), 0)
    g.contents.append(pages.where("page_content IS NOT NULL").withColumn("batch", F.lit(0)), 0)
    g.links.append(edges.withColumn("batch", F.lit(0)), 0)
    top = pages.agg(F.coalesce(F.max("page_id") + 1, F.lit(0)).alias("n"), F.count("page_content").alias("with_text")).first()
    return _closed(g, (top["with_text"], 0, edges.count()), (top["n"], top["with_text"], False))


def _closed(g: LinkGraph, counts: tuple[int, int, int], carried: tuple[int, int, bool]) -> LinkGraph:
    """Note the batch, which commits it, and go on to the next one."""
    names = [c.split()[0] for c in BATCHES_SCHEMA.split(", ")]
    values = [F.lit(x) for x in (*counts, *carried, g.batch)]
    row = g.spark.range(1).select(*[v.cast(c.split()[1]).alias(n) for v, n, c in zip(values, names, BATCHES_SCHEMA.split(", "))])
    g.batches.append(row.coalesce(1), g.batch)
    return LinkGraph(g.spark, g.folder, g.batch + 1, carried)


def parse_responses(responses: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Good responses parsed: ``(url, seq, text, hrefs)``; the last record
    per URL in the batch wins, pages with empty text are dropped.  Responses
    may carry the decoded ``text`` or the raw ``body`` bytes (decoded as
    UTF-8, invalid sequences replaced)."""
    good = good_responses(responses)
    html = F.col("text") if "text" in responses.columns else decode_body("body")
    good = good.select("url", F.col(seq_col).alias("seq"), html.alias("html"))
    parsed = lk.page_text(lk.parse_pages(good))
    return lk.last_per_url(parsed.select("url", "seq", "text", "hrefs"))


def _followed(batch: DataFrame, fetched: int, budget: int | None) -> DataFrame:
    """Pages whose links are followed: all, or those up to the crawl budget, counted over all batches."""
    if budget is None or fetched >= budget:
        return batch if budget is None else batch.where("false")
    order = with_global_position(batch.select("url", "seq"), ["seq", "url"], "n")
    return batch.join(order.where(F.col("n") < budget - fetched).select("url"), "url", "left_semi")


def ingest(graph: LinkGraph, responses: DataFrame, seq_col: str = "seq", budget: int | None = None,
           replace_links: bool = False) -> tuple[LinkGraph, DataFrame]:
    """One ingest batch.  Returns the graph after it and a one-row counter frame
    ``(pages_stored, stubs_added, edges_added)``.

    With ``budget`` only the first so many pages fetched, over all batches, have their links followed;
    with ``replace_links`` the links of re-crawled pages take the place of their earlier ones.
    """
    g = graph
    next_id, fetched, replaced = g.carried()
    # The parsed batch and its outlinks feed several branches; they are
    # batch-sized, so they are written once (HTML parsed once) and read back.
    batch = write_once(parse_responses(responses, seq_col), "ingest-batch")
    followed = _followed(batch, fetched, budget)
    links = write_once(lk.resolved_outlinks(followed.withColumn("page_id", F.lit(None).cast("bigint")))
                       .select("url", "outlink").distinct(), "ingest-links")
    touched = batch.select(F.col("url").alias("page_url"), F.lit(1).alias("page")) \
        .unionByName(links.select(F.col("outlink").alias("page_url"), F.lit(0).alias("page"))) \
        .groupBy("page_url").agg(F.max("page").alias("page"))
    known, placed = g.dictionary.placed(touched.withColumnRenamed("page_url", "key"), g.batch, next_id)
    new = placed.select(F.col("id").alias("page_id"), F.col("key").alias("page_url"))
    ids = known.select(F.col("id").alias("page_id"), F.col("key").alias("page_url")).unionByName(new)
    texts = batch.join(ids, F.col("url") == F.col("page_url")) \
        .select("page_id", F.col("text").alias("page_content"), F.lit(g.batch).alias("batch"))
    pairs = links.join(ids.select(F.col("page_id").alias("source_page_id"), F.col("page_url").alias("url")), "url") \
        .join(ids.select(F.col("page_id").alias("outgoing_page_id"), F.col("page_url").alias("outlink")), "outlink") \
        .select("source_page_id", "outgoing_page_id")
    if replace_links:  # a row without a target ends what the source had before
        ended = texts.select(F.col("page_id").alias("source_page_id"), F.lit(None).cast("bigint").alias("outgoing_page_id"))
        pairs = pairs.unionByName(ended)
    elif g.batch:
        pairs = missing_from(pairs, g.edges, ["source_page_id", "outgoing_page_id"])
    pairs = pairs.withColumn("batch", F.lit(g.batch))
    at_once(lambda: g.dictionary.log.append(placed, g.batch), lambda: g.contents.append(texts, g.batch), lambda: g.links.append(pairs, g.batch))
    # counted in what was written: right also where a lost task ran twice
    n_new, stubs, stored, added = at_once(
        lambda: placed.count(), lambda: placed.where("page = 0").count(), lambda: g.contents.of_batch(g.batch).count(),
        lambda: g.links.of_batch(g.batch).where("outgoing_page_id IS NOT NULL").count())
    after = _closed(g, (stored, stubs, added), (next_id + n_new, fetched + stored, replaced or replace_links))
    names = ["pages_stored", "stubs_added", "edges_added"]
    return after, g.batches.of_batch(g.batch).select(*names)


def compact(graph: LinkGraph) -> None:
    """Merge the runs of the stored tables by size."""
    for table in (graph.urls, graph.contents, graph.links, graph.batches):
        table.compact(graph.batch)
