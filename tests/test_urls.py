"""Outlink filter/resolution, canonical URLs, host keys and domains."""

import pytest
from pyspark.sql import functions as F

from spindex.functions.urls import (canonical_url, host_key, keep_outlink, registrable_domain,
                                    resolve_outlink)

BASE = "https://www.example.com/dir/page.html?x=1#frag"
# href -> resolved outlink (None: not kept)
OUTLINKS = {
    None: None, "": None, "/": BASE, "#top": BASE, "//cdn.x.org/a": "https://cdn.x.org/a",
    "../b": "https://www.example.com/b", "?q=1": "https://www.example.com/dir/page.html?q=1",
    "x.PDF": "https://www.example.com/dir/x.PDF", "x.pdf": None, "x.pdf#p": "https://www.example.com/dir/x.pdf",
    "x.pdf/": None, "mailto:a@b": None, "hotel:1": None, "tel:1": None, "javascript:void(0)": "javascript:void(0)",
    "http://a.b/": "http://a.b", "/login?next=https://x.org": "/login?next=https://x.org",
    "/" + "a" * 748: "https://www.example.com/" + "a" * 748, "/" + "a" * 749: None,
    "/a/./b/../c": "https://www.example.com/a/c", "/plain/path": "https://www.example.com/plain/path",
    "rel/x#y": "https://www.example.com/dir/rel/x", "HTTPS://UP.example.com/": "https://UP.example.com",
}


def test_outlinks(spark):
    hrefs = list(OUTLINKS)
    df = spark.createDataFrame([(i, BASE, h) for i, h in enumerate(hrefs)], "i INT, base STRING, href STRING")
    kept = df.where(keep_outlink("href")).select("i", resolve_outlink("base", "href").alias("o"))
    got = {hrefs[r["i"]]: r["o"] for r in kept.collect()}
    assert got == {h: o for h, o in OUTLINKS.items() if o is not None}


CANONICAL = {
    "http://a.com/p?x=&y=2": "http://a.com/p?y=2", "http://a.com/p?a=1&b=2&a=3": "http://a.com/p?a=1&a=3&b=2",
    "http://a.com/p?Ref=1&k=v": "http://a.com/p?k=v", "http://a.com/p?e=5&f=6": "http://a.com/p?f=6",
    "http://a.com/p?q=a%20b": "http://a.com/p?q=a+b", "http://a.com/p?q=1#": "http://a.com/p?q=1",
    "http://a.com/p#": "http://a.com/p", "http://a.com/p?utm_source=x&utm_medium=y": "http://a.com/p",
    "http://a.com/p?k=v#frag": "http://a.com/p?k=v#frag", "http://a.com/p": "http://a.com/p",
    "http://a.com/p?q=a+b&t=~x*": "http://a.com/p?q=a+b&t=~x%2A",
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in CANONICAL], "u STRING")
    got = {r["u"]: r["c"] for r in df.select("u", canonical_url("u").alias("c")).collect()}
    assert got == CANONICAL


@pytest.mark.parametrize("url,key,domain", [
    ("http://localhost/x", "http://", ""),
    ("http://127.0.0.1/x", "http://", ""),
    ("http://a.example.com:8080/x", "http://a.example.com", "example.com"),
    ("http://a.b.com/?u=https://x", "https://a.b.com", "b.com"),
    ("https://shop.a.co.uk/p", "https://shop.a.co.uk", "a.co.uk"),
    ("https://co.uk/", "https://", ""),
    ("http://user:pw@Mixed.Example.ORG./p", "http://mixed.example.org", "example.org"),
])
def test_domains(spark, url, key, domain):
    r = spark.createDataFrame([(url,)], "url STRING").select(
        host_key("url").alias("k"), registrable_domain("url").alias("d")).first()
    assert (r["k"], r["d"]) == (key, domain)


def test_links_that_are_joined_lose_empty_parts(spark):
    from spindex.functions.urls import resolve_outlink
    base = "https://h.com/d/p"
    cases = {"/a?": "https://h.com/a", "/a;": "https://h.com/a", "/a;?x=1": "https://h.com/a?x=1", "/a;p=1": "https://h.com/a;p=1",
             "/a?b;": "https://h.com/a?b;", "b?": "https://h.com/d/b", "//[x": None, "/a//b": "https://h.com/a//b"}
    df = spark.createDataFrame([(k,) for k in cases], "href STRING")
    got = {r["href"]: r["o"] for r in df.select("href", resolve_outlink(F.lit(base), "href").alias("o")).collect()}
    assert got == cases


def test_canonical_url_corner_cases(spark):
    from spindex.functions.urls import canonical_url
    cases = {"HTTPS://h.com/A": "https://h.com/A", "https://h.com/a;?b=1": "https://h.com/a?b=1", "https://h.com/a;;": "https://h.com/a;;",
             "https://h.com;": "https://h.com;", "https://h.com/a;b/c": "https://h.com/a;b/c", "https://h.com/a?q=%zz%41": "https://h.com/a?q=%25zzA",
             "https://h.com/a?q=50%": "https://h.com/a?q=50%25", " https://h.com/a\tb": "https://h.com/ab", "/p?x=1&UTM_source=2": "/p?x=1"}
    df = spark.createDataFrame([(k,) for k in cases], "u STRING")
    got = {r["u"]: r["c"] for r in df.select("u", canonical_url("u").alias("c")).collect()}
    assert got == cases


def test_top_level_names_beyond_the_built_in_list(spark):
    from spindex.functions.urls import host_key, registrable_domain
    cases = {"https://a.shop.xyz/": "shop.xyz", "https://www.firma.cz/": "firma.cz", "https://x.co.uk/": "x.co.uk", "https://a.xn--p1ai/": "a.xn--p1ai",
             "https://printer.local/": "", "https://localhost/": "", "https://1.2.3.4/": "", "https://co.uk/": "", "https://xyz/": ""}
    df = spark.createDataFrame([(k,) for k in cases], "u STRING")
    rows = df.select("u", registrable_domain("u").alias("d"), host_key("u").alias("k"), registrable_domain("u", ("com",)).alias("own")).collect()
    assert {r["u"]: r["d"] for r in rows} == cases
    assert len({r["k"] for r in rows if r["d"]}) == 4 and all(r["own"] == "" for r in rows)


def test_domains_by_a_table_of_rules(spark):
    from spindex.operators.domains import domains_by_rules
    rules = spark.createDataFrame([("com",), ("uk",), ("CO.uk",), ("*.ck",), ("!www.ck",), (None,), ("com",)], "rule STRING")
    cases = {"https://a.b.co.uk/": "b.co.uk", "https://b.uk/": "b.uk", "https://a.b.c.ck": "b.c.ck", "https://c.ck": "", "https://www.ck/": "www.ck",
             "https://a.www.ck/": "www.ck", "https://com/": "", "https://x.de/": "", "https://9.9.9.9/": "", "": "", None: ""}
    urls = spark.createDataFrame([(u, 1) for u in cases] + [("https://b.uk/", 1)], "url STRING, labels INT")
    rows = domains_by_rules(urls, rules).collect()
    assert len(rows) == len(cases) + 1 and {r["url"]: r["domain"] for r in rows} == cases
    assert {r["domain"] for r in domains_by_rules(urls, rules.where("false")).collect()} == {""}


def test_posting_blocks_follow_the_document_frequency(spark):
    from spindex.operators.index import posting_lists
    ids = spark.range(5000).select(F.xxhash64("id").alias("page_id"))
    postings = ids.select(F.lit("t").alias("term"), "page_id").union(spark.range(0, 3_000_000, 1000).select(F.lit("u").alias("term"), "id"))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("total_pages"))
    blocks = posting_lists(terms, postings).collect()
    assert sum(r["n_pages"] for r in blocks) == 8000
    assert sum(r["term"] == "t" for r in blocks) == 5 and sum(r["term"] == "u" for r in blocks) == 3
    assert max(r["n_pages"] for r in blocks) < 1500
