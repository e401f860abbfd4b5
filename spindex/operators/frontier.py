"""Frontier preparation: seen filter, domain grouping, politeness deferral,
robots filter and the domain interleave into fixed-size batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.constants import DEFAULT_PUBLIC_SUFFIXES
from spindex.functions.urls import registrable_domain
from spindex.operators.ordering import with_global_position


def domain_sizes(urls: DataFrame, suffixes=DEFAULT_PUBLIC_SUFFIXES) -> DataFrame:
    """``(domain, n_urls, domain_rank)``: distinct URLs per registrable
    domain; rank 1 is the largest (ties by domain name)."""
    d = (urls.select("url", registrable_domain("url", suffixes).alias("domain")).distinct()
         .groupBy("domain").agg(F.count(F.lit(1)).alias("n_urls")))
    ranked = with_global_position(d, [F.col("n_urls").desc(), F.col("domain")], "_pos")
    return ranked.select("domain", "n_urls", (F.col("_pos") + 1).alias("domain_rank"))


def unseen_urls(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct candidate URLs not in ``seen(url)`` (anti join)."""
    return urls.select("url").distinct().join(seen.select("url").distinct(), "url", "left_anti")


def valid_domain(urls: DataFrame, suffixes=DEFAULT_PUBLIC_SUFFIXES) -> DataFrame:
    """Drop URLs whose host key has no host (no public suffix: localhost,
    IP addresses, bare suffixes)."""
    from spindex.functions.urls import host_key
    hk = host_key("url", suffixes)
    return urls.where(~hk.isin("http://", "https://"))


def interleave(urls: DataFrame, batch_size: int = 50, exit_domains: int = 0,
               max_domains: int | None = None, suffixes=DEFAULT_PUBLIC_SUFFIXES):
    """Round-robin URLs over registrable domains into fixed-size batches.

    Domains are ordered by distinct URL count (largest first, ties by name);
    round ``r`` takes the ``r``-th URL (by URL order) of every domain that
    still has one, in domain order.  By default every URL is
    emitted.  With ``exit_domains`` above 0, when more than that many domains
    exist, rounds stop once no more than ``exit_domains`` domains remain: a
    round ``r`` is emitted only while more than ``exit_domains`` domains have
    at least ``r`` URLs (so it is emitted iff ``r`` is at most the size of
    the domain ranked ``exit_domains + 1``).  ``max_domains`` keeps only
    the first domains of the order.

    Returns ``(batches, leftover)``: ``batches(batch_id, pos, url, domain,
    round)`` and the URLs not emitted.  Positions come from distributed
    sorts (no single-task window), so a domain holding a third of all URLs
    still spreads over many tasks.
    """
    # what the URLs carry already (host dimension) is kept
    domain = F.col("domain") if "domain" in urls.columns else registrable_domain("url", suffixes)
    more = [c for c in urls.columns if c not in ("url", "domain")]
    u = urls.select("url", domain.alias("domain"), *more).dropDuplicates(["url"])
    # round = rank of the URL inside its domain: global position in
    # (domain, url) order minus the domain's first position.
    g = with_global_position(u, ["domain", "url"], "_g")
    first = g.groupBy("domain").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n_urls"))
    ranked = with_global_position(first, [F.col("n_urls").desc(), F.col("domain")], "_drank")
    n_domains = ranked.agg(F.count(F.lit(1)).alias("_nd"))
    cutoff = (ranked.where(F.col("_drank") == exit_domains)
              .select(F.col("n_urls").alias("_max_round")))
    limits = n_domains.join(cutoff, how="left").select(  # one row with at most one row
        F.when(F.col("_nd") > exit_domains, F.coalesce("_max_round", F.lit(0))).alias("_max_round"))
    dom = ranked.crossJoin(F.broadcast(limits))  # one row: proven bound
    if max_domains is not None:
        dom = dom.where(F.col("_drank") < max_domains)
    rows = (g.join(dom.select("domain", "_first", "_drank", "_max_round"), "domain")
            .withColumn("round", F.col("_g") - F.col("_first") + 1))
    emit = F.col("_max_round").isNull() | (F.col("round") <= F.col("_max_round"))
    kept = rows.where(emit)
    leftover = rows.where(~emit).select("url", "domain", "round")
    if max_domains is not None:
        leftover = leftover.unionByName(g.join(dom.select("domain"), "domain", "left_anti")
                                        .select("url", "domain", F.lit(None).cast("bigint").alias("round")))
    pos = with_global_position(kept, ["round", "_drank"], "_p")
    batches = pos.select(F.floor(F.col("_p") / F.lit(batch_size)).cast("bigint").alias("batch_id"),
                         F.pmod(F.col("_p"), F.lit(batch_size)).cast("bigint").alias("pos"),
                         "url", "domain", F.col("round").cast("bigint").alias("round"), *more)
    return batches, leftover
