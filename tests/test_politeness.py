"""Response filter, robots rules, waits, sleep and deferral."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindex.operators import politeness as po
from spindex.operators import robots as ro
from spindex.operators.responses import response_is_good

LIMIT = 3 * 1024 * 1024


@pytest.mark.parametrize("headers,good", [
    ({}, True),
    ({"Content-Length": str(LIMIT)}, True),
    ({"Content-Length": str(LIMIT + 1)}, False),
    ({"Content-Length": "abc"}, False),
    ({"Content-Length": ""}, False),
    ({"content-length": str(LIMIT + 1)}, False),
    ({"Content-Type": "TEXT/HTML"}, False),
    ({"Content-Type": "text/html; charset=utf-8"}, True),
    ({"Content-Type": ""}, True),
    ({"CONTENT-LANGUAGE": "fr"}, False),
    ({"Content-Language": "en-GB"}, True),
    ({"Content-Language": ""}, True),
])
def test_response_rules(spark, headers, good):
    df = spark.createDataFrame([(headers,)], "h MAP<STRING,STRING>")
    assert df.select(response_is_good("h")).first()[0] is good


ROBOTS = {
    "fail": (False, "User-agent: *\nDisallow: /"),
    "empty": (True, ""),
    "first": (True, "User-agent: *\nDisallow: /private\nAllow: /private/ok\nCrawl-delay: 2\nRequest-rate: 1/5\n"),
    "zero": (True, "User-agent: *\nDisallow: /x\nCrawl-delay: 0\n"),
    "other": (True, "User-agent: otherbot\nDisallow: /\nCrawl-delay: 10\n"),
}


def test_robots_parse_and_verdicts(spark):
    import urllib.robotparser
    rows = [(k, ok, t, dt.datetime(2024, 1, 1)) for k, (ok, t) in ROBOTS.items()]
    robots = spark.createDataFrame(rows, "host_key STRING, ok BOOLEAN, text STRING, fetched_at TIMESTAMP")
    rules = {r["host_key"]: r for r in ro.robots_rules(robots).collect()}
    assert rules["fail"]["robots"] is None
    assert rules["empty"]["robots"]["rate_limit"] == 0.0 and list(rules["empty"]["robots"]["rules"]) == []
    assert rules["first"]["robots"]["rate_limit"] == 5.0
    assert rules["zero"]["robots"]["rate_limit"] == 0.0
    assert rules["other"]["robots"]["rate_limit"] == 0.0
    paths = ["/private", "/private/ok/x", "/public", "/", "/x/y", "/a?b=c", "/caf%C3%A9"]
    for host, (ok, text) in ROBOTS.items():
        rp = urllib.robotparser.RobotFileParser()
        rp.parse(text.splitlines())
        r = rules[host]["robots"]
        arr = None if r is None else [(x["idx"], x["allow"], x["path"]) for x in r["rules"]]
        for p in paths:
            url = f"http://h.example.com{p}"
            want = True if r is None else rp.can_fetch("*", url)
            df = spark.createDataFrame([(url, arr)],
                                       "url STRING, rules ARRAY<STRUCT<idx:INT,allow:BOOLEAN,path:STRING>>")
            got = df.select(po.robots_verdict("rules", po.request_path("url"))).first()[0]
            assert got == want, (host, p)


def test_waits_and_sleep(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [
        ("http://a.example.com/1", 429, {"Retry-After": "120"}, t0),
        ("http://b.example.com/1", 503, {"Retry-After": "Wed, 21 Oct 2026 07:28:00 GMT"}, t0),
        ("http://c.example.com/1", 403, {"Retry-After": "junk"}, t0),
        ("http://d.example.com/1", 429, {"X": "y"}, t0),
        ("http://e.example.com/1", 404, {"Retry-After": "120"}, t0),
        ("http://f.example.com/1", 200, {"X": "y"}, t0),
        ("http://f.example.com/2", 200, {"X": "y"}, t0 + dt.timedelta(seconds=10)),
    ]
    resp = spark.createDataFrame(rows, "url STRING, status INT, headers MAP<STRING,STRING>, fetched_at TIMESTAMP")
    rules = spark.createDataFrame(
        [("http://e.example.com", (0.1, [])), ("http://f.example.com", (0.0, []))],
        "host_key STRING, robots STRUCT<rate_limit:DOUBLE, rules:ARRAY<STRUCT<idx:INT,allow:BOOLEAN,path:STRING>>>")
    w = {r["host_key"]: r["next_allowed_at"] for r in po.next_allowed(resp, rules).collect()}
    assert w["http://a.example.com"] == t0 + dt.timedelta(seconds=120)
    assert w["http://b.example.com"] == dt.datetime(2026, 10, 21, 7, 28)
    assert w["http://c.example.com"] == t0 + dt.timedelta(seconds=15)
    assert w["http://d.example.com"] == t0 + dt.timedelta(seconds=15)
    assert w["http://e.example.com"] == t0 + dt.timedelta(milliseconds=200)   # rate 0.1 floors to 0.2
    assert w["http://f.example.com"] == t0 + dt.timedelta(seconds=10, milliseconds=200)  # last write wins
    waits = spark.createDataFrame([("http://x.example.com", t0 + dt.timedelta(milliseconds=50)),
                                   ("http://y.example.com", t0 + dt.timedelta(seconds=1))],
                                  "host_key STRING, next_allowed_at TIMESTAMP")
    s = {r["host_key"]: r["sleep_seconds"] for r in po.sleep_times(waits, "2024-01-01 00:00:00").collect()}
    assert s == {"http://x.example.com": 0.0, "http://y.example.com": 1.0}
    urls = spark.createDataFrame([(f"http://y.example.com/{i}",) for i in range(3)] +
                                 [("http://y.example.com/0",), ("http://z.example.com/a",)], "url STRING")
    d = {r["url"]: r["deferred"] for r in po.defer_by_politeness(urls, waits, "2024-01-01 00:00:00").collect()}
    assert d["http://y.example.com/0"] is True      # 3 URLs x 1.0 s is not below 3
    assert d["http://z.example.com/a"] is False     # unknown host sleeps 0


@pytest.mark.parametrize("raw", [b"plain", b"abc\xff", b"\xe2\x82", b"x\xe2\x82y", b"\xc3\xa9t\xc3",
                                 b"\xf0\x9f\x98\x80 ok", b"\xed\xa0\x80", b"\xc0\xaf", b""])
def test_lenient_utf8_decode(spark, raw):
    from spindex.operators.responses import decode_body
    df = spark.createDataFrame([(bytearray(raw),)], "b BINARY")
    assert df.select(decode_body("b")).first()[0] == raw.decode("utf-8", errors="replace")


@pytest.mark.parametrize("text", ["Wed, 21 Oct 2026 07:28:00 GMT", "21 Oct 2026 07:28:00 GMT",
                                  "Thu, 1 Oct 2026 07:28:00 +0200", "Wed, 21 Oct 2026 07:28:00 +0000",
                                  "Wed, 21 Oct 2026 07:28 GMT", "Wed,  21 Oct 2026 07:28:00 UTC",
                                  "soon", "", "120s"])
def test_http_dates_match_email_utils(spark, text):
    from email.utils import parsedate_to_datetime
    try:
        want = parsedate_to_datetime(text).astimezone(dt.timezone.utc).replace(tzinfo=None)
    except (TypeError, ValueError, IndexError):
        want = None
    got = spark.createDataFrame([(text,)], "t STRING").select(po.http_date(F.col("t")).alias("d")).first()["d"]
    assert got == want


def test_http_date_forms(spark):
    from pyspark.sql import functions as F
    from spindex.operators.politeness import http_date
    want = {"Wed, 21 Oct 2026 07:28:00 GMT": "2026-10-21 07:28:00", "Wed Oct 21 07:28:00 2026": "2026-10-21 07:28:00",
            "Wednesday, 21-Oct-26 07:28:00 GMT": "2026-10-21 07:28:00", "Wed, 21 Oct 2026 07:28:00 EST": "2026-10-21 12:28:00",
            "Sunday, 06-Nov-94 08:49:37 GMT": "1994-11-06 08:49:37", "21 Oct 2026 07:28 +0200": "2026-10-21 05:28:00", "junk": None}
    df = spark.createDataFrame([(s,) for s in want], "s STRING")
    rows = df.select("s", F.date_format(http_date(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert {r["s"]: r["t"] for r in rows} == want
