"""Randomised inputs: properties that hold for any of them."""

import random
from urllib.parse import parse_qsl, urlsplit

import duckdb

from spindex.functions.constants import TRACKING_PARAMS
from spindex.functions.text import index_terms, query_terms
from spindex.functions.urls import canonical_url, keep_outlink, resolve_outlink
from spindex.operators import index as ix
from spindex.operators import search as se

ALPHABET = list("abcXYZ019_-#@ .,;:!?'\"()[]{}\\/*&~+|—ïéİK\t\nßñ")


def test_tokens_of_random_text(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, s STRING")
    own = set("abcdefghijklmnopqrstuvwxyz0123456789_-#@")
    for r in df.select("i", index_terms("s").alias("a"), query_terms("s").alias("b")).collect():
        assert all(t and set(t) <= own for t in [*r["a"], *r["b"]])
        if texts[r["i"]].isascii():  # the tokenizers differ on other characters only
            assert r["a"] == r["b"]


def test_search_on_random_corpus(spark):
    rng = random.Random(5)
    vocab = ["lion", "tiger", "zebra", "mouse", "horse", "eagle", "whale", "snake"]
    pages = {i: [rng.choice(vocab) for _ in range(rng.randint(1, 30))] for i in range(1, 61)}
    queries = [[rng.choice(vocab) for _ in range(rng.randint(1, 5))] for _ in range(25)]
    corpus = spark.createDataFrame([(i, f"https://h.example.com/{i:02d}", " ".join(t)) for i, t in pages.items()],
                                   "page_id BIGINT, page_url STRING, page_content STRING")
    q = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(queries)], "query_id BIGINT, query_text STRING")
    rows = sorted(tuple(r) for r in se.search(q, corpus, k=10).select("query_id", "rank", "page_url", "similarity").collect())
    # cosine of tf-idf vectors over the query's terms, set-based in SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE p(page INT, term VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", [(i, t) for i, ts in pages.items() for t in ts])
    con.execute("CREATE TABLE q(query INT, term VARCHAR)")
    con.executemany("INSERT INTO q VALUES (?, ?)", [(i, t) for i, ts in enumerate(queries) for t in ts])
    want = con.sql("""WITH idf AS (SELECT term, 1 + log10(60.0 / count(DISTINCT page)) AS w FROM p GROUP BY term),
      tf AS (SELECT page, term, count(*) / sum(count(*)) OVER (PARTITION BY page) AS f FROM p GROUP BY page, term),
      qf AS (SELECT query, term, count(*) / sum(count(*)) OVER (PARTITION BY query) AS f FROM q GROUP BY query, term),
      qn AS (SELECT query, sqrt(sum((f * w) ** 2)) AS n FROM qf JOIN idf USING (term) GROUP BY query),
      s AS (SELECT query, page, sum(qf.f * w * tf.f * w) / (any_value(n) * sqrt(sum((tf.f * w) ** 2))) AS sim
            FROM qf JOIN idf USING (term) JOIN tf USING (term) JOIN qn USING (query) GROUP BY query, page),
      r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(round(sim, 12) ** 1.2, 9) DESC, page) AS rank FROM s)
      SELECT query, rank, 'https://h.example.com/' || lpad(page::VARCHAR, 2, '0'), round(sim, 9) FROM r WHERE rank <= 10
      ORDER BY query, rank""").fetchall()
    assert [r[:2] for r in rows] == [r[:2] for r in want]
    assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(rows, want))
    # a stored full index gives the same answers as the query-scoped one
    terms, postings = ix.build_index(corpus)
    assert sorted(tuple(r) for r in se.search(q, corpus, terms, postings, k=10)
                  .select("query_id", "rank", "page_url", "similarity").collect()) == rows


def test_canonical_urls_of_random_queries(spark):
    rng = random.Random(3)
    keys = ["a", "b", "Ref", "utm_source", "e", "q", "fbclid", "x y", "k"]
    vals = ["1", "", "two", "a b", "a+b", "%20", "~", "x*y", "é"]
    urls = []
    for _ in range(300):
        q = "&".join(f"{rng.choice(keys)}={rng.choice(vals)}" for _ in range(rng.randint(0, 5)))
        urls.append(f"http://a.example.com/p?{q}{rng.choice(['', '#', '#top'])}")
    df = spark.createDataFrame([(u,) for u in urls], "u STRING").withColumn("c", canonical_url("u"))
    for r in df.withColumn("again", canonical_url("c")).collect():
        pairs = parse_qsl(urlsplit(r["c"]).query, keep_blank_values=True)
        assert all(v and k.lower() not in TRACKING_PARAMS for k, v in pairs)
        assert r["again"] == r["c"] and urlsplit(r["c"]).path == "/p"
        kept = [kv for kv in parse_qsl(urlsplit(r["u"]).query) if kv[0].lower() not in TRACKING_PARAMS]
        assert sorted(pairs) == sorted(kept)


def test_outlinks_of_random_hrefs(spark):
    rng = random.Random(9)
    parts = ["/", "a", "b.", "..", ".", "x.pdf", "x.js", "#f", "?q=1", "//h.example.org", "https://s.example.net",
             "http://p.example.com", "mailto:", "tel:", " "]
    rows = [(i, "https://www.example.com/d/p.html?x=1#f", "".join(rng.choice(parts) for _ in range(rng.randint(0, 4))))
            for i in range(400)]
    df = spark.createDataFrame(rows, "i INT, base STRING, href STRING")
    kept = {r["i"]: r["o"] for r in df.where(keep_outlink("href")).select("i", resolve_outlink("base", "href").alias("o")).collect()}
    for i, base, href in rows:
        dropped = not href or "mailto:" in href or "tel:" in href or href.rstrip("/").endswith((".pdf", ".js"))
        assert (i not in kept) == dropped, href
        if i in kept and href.startswith("https://") and "#" not in href:
            assert kept[i] == href.rstrip("/")
