"""robots.txt responses per host.

Fetching is outside Spark; a crawl round hands over ``(host_key, ok, text,
fetched_at)``.  ``robots_responses`` derives one per host of the given URLs
from five literal files (chosen by host length) so every case occurs: a
failed fetch, an empty file, first-match rules with crawl-delay and
request-rate, a zero delay, and rules for another agent only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.timeutil import utc_instant
from spindex.functions.urls import host_key, url_fqdn

# Fixture texts, indexed by length(host) % 5; index 0 is a failed fetch.
ROBOTS_TEXTS = (
    None,
    "",
    "User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 2\nRequest-rate: 1/5\n",
    "User-agent: *\nDisallow: /fr/\nDisallow: /es\nAllow: /\nCrawl-delay: 0\n",
    "User-agent: otherbot\nDisallow: /\nCrawl-delay: 10\n\nUser-agent: *\nAllow: /en/\nDisallow: /\n",
)
FETCHED_AT = "2024-01-01 00:00:00"


def robots_responses(urls: DataFrame) -> DataFrame:
    hosts = (urls.select(host_key("url").alias("host_key"), url_fqdn("url").alias("host"))
             .where(F.col("host") != "").distinct())
    k = F.pmod(F.length("host"), F.lit(len(ROBOTS_TEXTS)))
    text = None
    for i, t in enumerate(ROBOTS_TEXTS):
        v = F.lit(t).cast("string")
        text = F.when(k == i, v) if text is None else text.when(k == i, v)
    return hosts.select("host_key", (k != 0).alias("ok"), text.alias("text"),
                        utc_instant(FETCHED_AT).alias("fetched_at"))
