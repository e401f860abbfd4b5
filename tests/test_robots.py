"""robots.txt tables against the standard library's parser, on made-up and random files."""

import datetime as dt
import random
import urllib.robotparser

from pyspark.sql import functions as F

from spindex.operators import politeness as po
from spindex.operators import robots as ro

SCHEMA = "host_key STRING, ok BOOLEAN, text STRING, fetched_at TIMESTAMP"
T0 = dt.datetime(2024, 1, 1)

FILES = [
    "User-agent: *\nDisallow: /a\n\nDisallow: /not-in-a-group\nUser-agent: *\nDisallow: /second-default",
    "User-agent: spindexbot\nCrawl-delay: 7\nUser-agent: *\nCrawl-delay: 3",
    "User-agent: Spindex\nUser-agent: other\nRequest-rate: 2 / 9\nCrawl-delay: 4\nDisallow: /x",
    "User-agent: a\n\nUser-agent: *\n# note\nDisallow:\nAllow: /b",
    "user-agent:*\r\nDISALLOW: /p%20q # tail\r\n   \r\nAllow: /p+q?x=%zz\r\nCrawl-delay: soon\r\nCrawl-delay: 2\r\nRequest-rate: 0/5",
    "Disallow: /early\nUser-agent: *\nSitemap: http://x/y\nDisallow: /late;\nDisallow: /q?#\nDisallow: *",
    "User-agent:\nDisallow: /unnamed\n\nUser-agent: *\nDisallow: /named",
    "User-agent: *\n\n\nDisallow: /lost",
    "no colon here\nUser-agent: *\nCrawl-delay: 5\nRequest-rate: 3/0",
    "User-agent: *\x0bDisallow: /vt\x85Allow: /nel Disallow: /ls\n",
    "﻿User-agent: *\nDisallow: /é/日本",
    "", "\n\n", "User-agent: *",
]


def random_file(rng):
    fields = ["User-agent: *", "User-agent: spindexbot", "User-agent: otherbot", "User-agent: SPIN", "Disallow: /a", "Disallow:", "Allow: /b/c",
              "Allow: /%7Ex", "Crawl-delay: 3", "Crawl-delay: 0", "Crawl-delay: x", "Request-rate: 1/4", "Request-rate: 5/1", "Request-rate: 0/9",
              "Request-rate: 1/0", "", "", "# note", "  ", "Sitemap: /s", "junk", "Disallow: /d # e"]
    return rng.choice(["\n", "\r\n"]).join(rng.choices(fields, k=rng.randrange(0, 14)))


def expected(text, agent):
    """Rules for any agent and the pace of ``agent``, as the standard library reads the file."""
    rp = urllib.robotparser.RobotFileParser()
    rp.parse(text.splitlines())
    group = next((e for e in rp.entries if e.applies_to("*")), rp.default_entry)
    rules = [(i, bool(r.allowance), r.path) for i, r in enumerate(group.rulelines)] if group else []
    rate = rp.request_rate(agent)
    paces = [rp.crawl_delay(agent) or 0, rate.seconds / rate.requests if rate and rate.requests else 0]
    return float(max(paces)), rules, rp


def test_tables_equal_the_standard_parser(spark):
    rng = random.Random(19)
    files = FILES + [random_file(rng) for _ in range(300)]
    df = spark.createDataFrame([(str(i), True, t, T0) for i, t in enumerate(files)], SCHEMA)
    got = {int(r["host_key"]): r["robots"] for r in ro.robots_rules(df).collect()}
    assert len(got) == len(files)
    for i, text in enumerate(files):
        limit, rules, _ = expected(text, ro.DEFAULT_AGENT)
        assert [(x["idx"], x["allow"], x["path"]) for x in got[i]["rules"]] == rules, text
        assert got[i]["rate_limit"] == limit, text


def test_verdicts_equal_the_standard_parser(spark):
    urls = [f"http://h.com{p}" for p in ("", "/", "/a", "/a/b", "/b/c", "/d", "/~x", "/p%20q", "/late", "/q", "/é/日本", "/p+q?x=1")]
    df = spark.createDataFrame([(str(i), True, t, T0) for i, t in enumerate(FILES)], SCHEMA)
    pairs = ro.robots_rules(df).crossJoin(F.broadcast(spark.createDataFrame([(u,) for u in urls], "url STRING")))  # a dozen of each
    got = pairs.select("host_key", "url", po.robots_verdict(F.col("robots.rules"), po.request_path("url")).alias("ok")).collect()
    for r in got:
        assert r["ok"] == expected(FILES[int(r["host_key"])], ro.DEFAULT_AGENT)[2].can_fetch("*", r["url"]), (r, FILES[int(r["host_key"])])


def test_first_fetch_counts_and_failures_give_no_rules(spark):
    rows = [("a", False, "User-agent: *\nDisallow: /", T0), ("a", True, "User-agent: *\nDisallow: /", T0 + dt.timedelta(seconds=1)),
            ("b", True, None, T0), ("c", None, "x", T0), (None, True, "User-agent: *\nAllow: /z", T0)]
    got = {r["host_key"]: r for r in ro.robots_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a"]["robots"] is None and got["a"]["ok"] is False
    assert got["b"]["robots"] is None and got["c"]["robots"] is None
    assert ro.robots_rules(spark.createDataFrame([], SCHEMA)).count() == 0
