"""HTML text and href extraction."""

from spindex.functions.html import parse_html, read_html


def test_removed_elements_and_entities():
    html = ("<html><head><title>T</title><style>p{}</style></head><body>"
            "<script>var x='<p>no</p>';</script>a<!-- c -->b <b>bold</b><i>it</i> &amp; &copy; &quot;q&quot;"
            "<p document>hidden</p><meta name=x>tail\x00end</body></html>")
    text, hrefs = read_html(html)
    assert text == 'a b bold it & © "q" tailend'  # NUL removed after whitespace collapse
    assert hrefs == []


def test_hrefs_in_order_with_duplicates_and_missing():
    html = '<body><a href="/x">1</a><a>2</a><a href="/x">3</a><a href="">4</a><a href="/y"/></body>'
    text, hrefs = read_html(html)
    assert hrefs == ["/x", None, "/x", "", "/y"]
    assert text == "1 2 3 4"


def test_unclosed_head_and_empty_body():
    text, hrefs = read_html('<head><title>x</title><body><a href="/only"></a></body>')
    assert text == "" and hrefs == ["/only"]


def test_udf_matches_helper(spark):
    pages = ["<p>a<b>b</b></p>", None, "<div>x&nbsp;y</div>"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i INT, h STRING")
    got = {r["i"]: (r["p"]["text"], list(r["p"]["hrefs"]) if r["p"]["hrefs"] is not None else None)
           for r in df.select("i", parse_html("h").alias("p")).collect()}
    for i, h in enumerate(pages):
        t, links = read_html(h)
        assert got[i] == (t, links)


def test_an_unknown_marked_section_is_skipped():
    assert read_html("<p>a</p><![foo bar]><p>d</p><a href=/x>") == ("a d", ["/x"])


def test_hostile_pages_take_linear_time():
    import time
    for piece in ("<a ", '<a x="', "</a ", "<!--", "<a b='", "<title>", "<", "<a  ", "<div document>", "</div>", "<script", "<p><head>", "&amp"):
        page = piece * (3 * 1024 * 1024 // len(piece))  # as large as a response may be
        start = time.process_time()
        read_html(page)
        assert time.process_time() - start < 30, piece


def test_what_is_never_closed_ends_the_markup():
    assert read_html('<p>a</p><a href="/x') == ("a", [])
    assert read_html("<p>a</p><!-- b <p>c") == ("a", [])
    assert read_html("<p>a</p><script>b</scrip") == ("a", [])
    assert read_html("1 < 2 <b>and 3<4</b> </ p> </") == ("1 < 2 and 3<4 </", [])
    assert read_html("<a =x href = '/q?a=1&amp;b' HREF=/no>t</a >") == ("t", ["/q?a=1&b"])
    assert read_html("<title>a &lt; <b></title>x<textarea>&amp;<i></TEXTAREA>y") == ("x &<i> y", [])


def test_random_markup_raises_nothing():
    import random
    rng = random.Random(1)
    parts = ["<", ">", "/", "a", "=", '"', "'", " ", "!--", "-->", "script", "&amp;", "</", "title", "\x00", "?", "é", "href", "![CDATA["]
    for _ in range(20_000):
        text, hrefs = read_html("".join(rng.choices(parts, k=rng.randrange(30))))
        assert "\x00" not in text and isinstance(hrefs, list)


def test_small_arrow_batches_in_sessions_made_by_others(spark, tmp_path):
    """A Python worker holds few pages at a time, whatever the session's own setting."""
    from spindex.catalog import registry
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.createDataFrame([(1, "https://a.com/", "<p>hi</p>")], "page_id BIGINT, url STRING, html STRING") \
        .write.parquet(str(tmp_path / "pages.parquet"))
    try:
        for setting, held in (("10000", 256), ("0", 256), ("32", 32)):
            spark.conf.set(key, setting)
            rows = registry()["page_text"](spark, str(tmp_path)).collect()
            assert [r["text"] for r in rows] == ["hi"] and int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)
