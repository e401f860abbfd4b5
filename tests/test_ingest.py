"""Upsert, stubs, add-only edges on literal batches."""


from spindex.plans.ingest import empty_graph, ingest

SCHEMA = ("url STRING, ok BOOLEAN, status INT, headers MAP<STRING,STRING>, text STRING, "
          "received BOOLEAN, fetched_at TIMESTAMP, seq BIGINT")


def _resp(spark, rows):
    full = [(u, True, 200, {"Content-Type": "text/html"}, h, True, None, s) for u, h, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def _state(g):
    pages = {r["page_url"]: r["page_content"] for r in g.pages.collect()}
    ids = {r["page_id"]: r["page_url"] for r in g.pages.collect()}
    edges = {(ids[r["source_page_id"]], ids[r["outgoing_page_id"]]) for r in g.edges.collect()}
    return pages, edges


def test_last_record_wins_and_stub_then_content(spark):
    a, b = "https://s.example.com/a", "https://s.example.com/b"
    g1, c1 = ingest(empty_graph(spark), _resp(spark, [
        (a, '<p>old</p><a href="/b">b</a>', 1),
        (a, '<p>new</p><a href="/b">b</a><a href="/c">c</a>', 2)]))
    pages, edges = _state(g1)
    assert pages[a] == "new b c"
    assert pages[b] is None and pages["https://s.example.com/c"] is None
    assert edges == {(a, b), (a, "https://s.example.com/c")}
    assert c1.first().asDict() == {"pages_stored": 1, "stubs_added": 2, "edges_added": 2}
    # stub then content; re-crawl of a with fewer links keeps the old edges
    g2, _ = ingest(g1, _resp(spark, [(b, "<p>page b</p>", 3), (a, "<p>again</p>", 4)]))
    pages2, edges2 = _state(g2)
    assert pages2[b] == "page b" and pages2[a] == "again"
    assert edges2 == edges
    ids1 = {r["page_url"]: r["page_id"] for r in g1.pages.collect()}
    ids2 = {r["page_url"]: r["page_id"] for r in g2.pages.collect()}
    assert all(ids2[u] == i for u, i in ids1.items())


def test_content_then_stub_and_empty_pages(spark):
    a, b = "https://t.example.com/a", "https://t.example.com/b"
    g1, _ = ingest(empty_graph(spark), _resp(spark, [(b, "<p>b text</p>", 1)]))
    g2, _ = ingest(g1, _resp(spark, [(a, '<p>a</p><a href="/b">x</a>', 2),
                                     ("https://t.example.com/empty", '<a href="/z">', 3)]))
    pages, edges = _state(g2)
    assert pages[b] == "b text"                       # existing content kept
    assert "https://t.example.com/empty" not in pages  # empty text: not stored
    assert "https://t.example.com/z" not in pages      # and its links not followed
    assert edges == {(a, b)}


def test_raw_body_is_decoded_leniently(spark):
    schema = ("url STRING, ok BOOLEAN, status INT, headers MAP<STRING,STRING>, body BINARY, "
              "received BOOLEAN, fetched_at TIMESTAMP, seq BIGINT")
    body = bytearray("<p>café ".encode() + b"\xff</p>")
    r = spark.createDataFrame([("https://u.example.com/x", True, 200, {}, body, True, None, 1)], schema)
    g, _ = ingest(empty_graph(spark), r)
    assert g.pages.first()["page_content"] == "café �"


def test_parsed_page_record(spark):
    from spindex.operators.links import outlink_lists, parse_pages
    pages = spark.createDataFrame(
        [(1, "https://r.example.com/a/b", '<p>t</p><a href="/x/">1</a><a href="y#z">2</a><a href="/x">3</a>'
                                          '<a href="mailto:q@r">m</a>'),
         (2, "https://r.example.com/e", '<a href="/only">')],
        "page_id BIGINT, url STRING, html STRING")
    rec = {r["page_id"]: (r["text"], list(r["outlinks"])) for r in outlink_lists(parse_pages(pages)).collect()}
    assert rec == {1: ("t 1 2 3 m", ["https://r.example.com/x", "https://r.example.com/a/y",
                                     "https://r.example.com/x"])}
