"""Frontier preparation: which URLs to fetch next, in which batches.

unseen (anti join) -> valid host -> domain interleave into batches -> per
batch: politeness deferral, then robots.  Every valid candidate comes back as
exactly one of: in a batch, deferred (back to the frontier), disallowed by
robots.txt, or leftover of the interleave (none by default).  A host's wait is
weighed against its URLs in one batch, so the share deferred does not grow with
the frontier.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.constants import FRONTIER_BATCH_SIZE, FRONTIER_EXIT_DOMAINS
from spindex.operators import frontier as fr
from spindex.operators import politeness as po
from spindex.operators.hosts import with_hosts


@dataclass
class Frontier:
    batches: DataFrame
    deferred: DataFrame
    disallowed: DataFrame
    leftover: DataFrame


def prepare_frontier(urls: DataFrame, seen: DataFrame, waits: DataFrame, rules: DataFrame,
                     as_of, batch_size: int = FRONTIER_BATCH_SIZE,
                     exit_domains: int = FRONTIER_EXIT_DOMAINS,
                     max_domains: int | None = None,
                     suffix_rules: DataFrame | None = None) -> Frontier:
    """``suffix_rules(rule)``: a table of public-suffix rules (the built-in rule without it).  Hosts are
    resolved once and what they give is carried along."""
    named = with_hosts(fr.unseen_urls(urls, seen), suffix_rules)
    cand = named.where("domain <> ''").select("url", "domain", "host_key")
    planned, leftover = fr.interleave(cand, batch_size, exit_domains, max_domains)
    d = po.defer_by_politeness(planned, waits, as_of, ["batch_id"])
    ready = d.where(~F.col("deferred")).drop("n_urls", "sleep_seconds", "deferred")
    checked = po.robots_allowed(ready, rules)
    return Frontier(checked.where(F.col("allowed")).select("batch_id", "pos", "url", "domain", "round"),
                    d.where(F.col("deferred")).select("batch_id", "url", "host_key", "n_urls", "sleep_seconds"),
                    checked.where(~F.col("allowed")).select("batch_id", "url", "host_key"), leftover)


def crawl_budget(fetch_order: DataFrame, budget: int) -> DataFrame:
    """``fetch_order(url, seq)`` plus ``fetch_rank`` (1-based) and
    ``emits_links``: pages fetched after the budget is spent still give
    text, but their links are not followed."""
    from spindex.operators.ordering import with_global_position
    r = with_global_position(fetch_order, ["seq", "url"], "_p")
    return r.withColumn("fetch_rank", F.col("_p") + 1).drop("_p") \
        .withColumn("emits_links", F.col("fetch_rank") <= budget)
