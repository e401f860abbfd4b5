"""Registrable domains by a table of public-suffix rules.

The list of public suffixes is data here: a table ``rule`` in the public list's
form (``com``, ``co.uk``, ``*.ck``, ``!www.ck``).  Every distinct host is
exploded into the rules that could hold for it, which are joined with the table
on equality; a host that very many URLs share is looked up once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.urls import url_host


def host_suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, n_suffix)``: labels of each host's public suffix; hosts without one are absent.

    An exception rule wins, else the rule with the most labels.  Blank and
    repeated rules, and letter case, do not matter.
    """
    known = rules.select(F.lower(F.trim("rule")).alias("rule")).where("rule <> ''").distinct()
    tails = hosts.select("host").where("host <> ''").distinct() \
        .withColumn("labels", F.split("host", r"\.")).withColumn("n", F.size("labels")) \
        .select("host", "labels", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("m"))
    tail = F.array_join(F.slice("labels", F.col("n") - F.col("m") + 1, F.col("m")), ".")
    tails = tails.select("host", "m", "n", tail.alias("tail"))
    # a plain rule, an exception (its suffix is one label shorter), a wildcard one label below the tail
    forms = F.array(
        F.struct(F.col("tail").alias("rule"), F.col("m").alias("size"), F.lit(0).alias("exception")),
        F.struct(F.concat(F.lit("!"), "tail").alias("rule"), (F.col("m") - 1).alias("size"), F.lit(1).alias("exception")),
        F.struct(F.concat(F.lit("*."), "tail").alias("rule"), (F.col("m") + 1).alias("size"), F.lit(0).alias("exception")))
    asked = tails.select("host", "n", F.explode(forms).alias("f")).select("host", "n", "f.*").where("size <= n")
    return asked.join(known, "rule").groupBy("host") \
        .agg(F.max(F.struct("exception", "size")).alias("best")).select("host", F.col("best.size").alias("n_suffix"))


def domains_by_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` plus ``host`` and ``domain``: the label below the host's public suffix with that suffix.

    ``domain`` is empty for hosts without a rule (IP addresses, unlisted names) and for bare suffixes;
    null URLs have a null host and an empty domain.
    """
    named = urls.withColumn("host", url_host(url_col))
    found = host_suffixes(named.select("host"), rules)
    size = F.col("n_suffix") + 1
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) >= size, F.array_join(F.slice(labels, F.size(labels) - size + 1, size), "."))
    return named.join(found, "host", "left").withColumn("domain", F.coalesce(domain, F.lit(""))) \
        .select(*urls.columns, "host", "domain")
