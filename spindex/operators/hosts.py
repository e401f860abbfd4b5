"""The host dimension: every distinct host resolved once.

URLs are many, hosts few: the registrable domain of each distinct host is worked
out once, by a joined table of public-suffix rules or by the built-in rule, written,
and joined back to whatever needs it (interleave, politeness, robots).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.urls import domain_of_host, host_key_of, url_host
from spindex.operators.domains import host_suffixes
from spindex.session import materialize as write_once


def host_dimension(hosts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(host, domain)`` of the distinct hosts of ``hosts(host)``, written once.

    ``rules(rule)`` is a table of public-suffix rules (plain, ``*.`` and ``!``); without it the built-in
    rule holds.  The domain is empty for hosts without a label above a public suffix.
    """
    distinct = hosts.select("host").where("host <> ''").distinct()
    if rules is None:
        named = distinct.select("host", domain_of_host("host").alias("domain"))
    else:
        size, labels = F.col("n_suffix") + 1, F.split("host", r"\.")
        domain = F.when(F.size(labels) >= size, F.array_join(F.slice(labels, F.size(labels) - size + 1, size), "."))
        named = distinct.join(host_suffixes(distinct, rules), "host", "left").select("host", F.coalesce(domain, F.lit("")).alias("domain"))
    return write_once(named, "hosts")


def with_hosts(urls: DataFrame, rules: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``domain`` and ``host_key`` (scheme and host; only the scheme without a domain)."""
    named = urls.withColumn("host", url_host(url_col))
    found = named.join(host_dimension(named, rules), "host", "left").withColumn("domain", F.coalesce("domain", F.lit("")))
    return found.withColumn("host_key", host_key_of(url_col, "host", "domain")) \
        .select(*urls.columns, "host", "domain", "host_key")
