"""Append-only tables: what a batch writes, merging, earlier states, replay; and what is built on them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spindex.plans import ingest as ing
from spindex.sources.log_table import LogTable
from spindex.streaming.state import scratch_dir

RESPONSES = ("url STRING, ok BOOLEAN, status INT, headers MAP<STRING,STRING>, text STRING, "
             "received BOOLEAN, fetched_at TIMESTAMP, seq BIGINT")


def log(spark, newest=None):
    return LogTable(spark, scratch_dir(spark, "log-test"), "k BIGINT, v STRING, batch BIGINT", "k", newest=newest)


def rows(spark, batch, n=300, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"), F.concat(F.lit(f"{batch}-"), F.col("id").cast("string")).alias("v"),
                                                F.lit(batch).cast("bigint").alias("batch"))


def test_a_batch_writes_what_it_brings(spark):
    t = log(spark)
    for b in range(6):
        t.append(rows(spark, b, start=300 * b), b)
    sizes = [r.size for r in t.committed()]
    assert max(sizes) < 1.5 * min(sizes)  # the sixth as little as the first
    assert t.rows().count() == 1800 and t.rows(before=2).count() == 600 and t.latest() == 5
    assert t.of_batch(3).count() == 300
    t.append(rows(spark, 5, n=10, start=1500), 5)  # replayed with other rows
    assert t.rows().count() == 1510


def test_runs_are_merged_by_size_and_earlier_states_stay(spark):
    t = log(spark, newest="batch")
    for b in range(5):
        t.append(rows(spark, b, n=200), b)  # the same keys again
    before = {r["k"]: r["v"] for r in t.current(before=3).collect()}
    merged = t.compact(growth=2, least=4)
    assert (merged.first, merged.last) == (0, 4) and [(r.first, r.last) for r in t.runs()] == [(0, 4)]
    assert t.rows().count() == 200  # superseded rows are gone
    assert {r["v"] for r in t.current().collect()} == {f"4-{k}" for k in range(200)}
    assert {r["k"]: r["v"] for r in t.current(before=3).collect()} == before == {k: f"2-{k}" for k in range(200)}
    t.append(rows(spark, 5, n=5), 5)
    assert t.compact() is None  # a small run beside a large one stays
    assert t.drop_merged() == 5 and len(t.committed()) == 2 and t.current().count() == 200


def test_an_empty_table_and_an_uncommitted_run(spark):
    t = log(spark)
    assert t.rows().count() == 0 and t.rows().columns == ["k", "v", "batch"] and t.latest() == -1 and t.compact() is None
    rows(spark, 0).withColumn("bucket", F.lit(0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .partitionBy("bucket").parquet(f"{t.path}/run=0-0")
    assert t.rows().count() == 0
    t.append(rows(spark, 0, n=0), 0)
    assert t.rows().count() == 0 and t.latest() == 0


def responses(spark, triples):
    full = [(u, True, 200, {}, h, True, None, s) for u, h, s in triples]
    return spark.createDataFrame(full, RESPONSES)


def edges(g):
    urls = {r["page_id"]: r["page_url"] for r in g.pages.collect()}
    return {(urls[r["source_page_id"]], urls[r["outgoing_page_id"]]) for r in g.edges.collect()}


def page(*links):
    return "<p>t</p>" + "".join(f'<a href="/{x}">l</a>' for x in links)


def test_ids_are_dense_and_stay(spark):
    u = "https://d.example.com/"
    g, _ = ing.ingest(ing.empty_graph(spark), responses(spark, [(u + "a", page("b", "c"), 1)]))
    g2, _ = ing.ingest(g, responses(spark, [(u + "c", page("d", "a"), 2), (u + "z", page(), 3)]))
    ids = {r["page_url"]: r["page_id"] for r in g2.pages.collect()}
    assert sorted(ids.values()) == list(range(5))
    assert {r["page_url"]: r["page_id"] for r in g.pages.collect()} == {x: ids[x] for x in (u + "a", u + "b", u + "c")}
    ing.compact(g2)
    assert g2.pages.count() == 5


def test_given_ids_are_kept(spark):
    pages = spark.createDataFrame([(70, "https://k.example.com/a", "x"), (7, "https://k.example.com/b", None)],
                                  "page_id BIGINT, page_url STRING, page_content STRING")
    g = ing.graph_of(pages, spark.createDataFrame([(70, 7)], "source_page_id BIGINT, outgoing_page_id BIGINT"))
    g, counts = ing.ingest(g, responses(spark, [("https://k.example.com/b", page("a", "n"), 1)]))
    got = {r["page_url"]: (r["page_id"], r["page_content"]) for r in g.pages.collect()}
    assert got == {"https://k.example.com/a": (70, "x"), "https://k.example.com/b": (7, "t l l"), "https://k.example.com/n": (71, None)}
    assert counts.first().asDict() == {"pages_stored": 1, "stubs_added": 1, "edges_added": 2}


def test_the_budget_is_counted_over_rounds(spark):
    u = "https://e.example.com/"
    one = responses(spark, [(u + "1", page("x1"), 1), (u + "2", page("x2"), 2)])
    two = responses(spark, [(u + "4", page("x4"), 4), (u + "3", page("x3"), 3)])
    g, _ = ing.ingest(ing.empty_graph(spark), one, budget=3)
    g, _ = ing.ingest(g, two, budget=3)
    g, _ = ing.ingest(g, responses(spark, [(u + "5", page("x5"), 5)]), budget=3)
    assert {t for _, t in edges(g)} == {u + "x1", u + "x2", u + "x3"}
    assert g.pages.where("page_content IS NOT NULL").count() == 5  # text is kept all the same


def test_links_of_recrawled_pages_may_be_replaced(spark):
    u = "https://f.example.com/"
    g, _ = ing.ingest(ing.empty_graph(spark), responses(spark, [(u + "1", page("a", "b"), 1), (u + "2", page("a"), 2)]))
    g, _ = ing.ingest(g, responses(spark, [(u + "1", page("b", "c"), 3)]), replace_links=True)
    assert edges(g) == {(u + "1", u + "b"), (u + "1", u + "c"), (u + "2", u + "a")}
    g, _ = ing.ingest(g, responses(spark, [(u + "1", page("a"), 4), (u + "2", page("d"), 5)]))  # add-only again
    assert edges(g) == {(u + "1", u + x) for x in "abc"} | {(u + "2", u + "a"), (u + "2", u + "d")}


def test_bytes_per_micro_batch_do_not_grow(spark):
    g = ing.empty_graph(spark)
    for b in range(4):
        urls = [(f"https://h{b}.example.com/{i}", page(*(f"{i}-{j}" for j in range(5))), b * 100 + i) for i in range(60)]
        g, _ = ing.ingest(g, responses(spark, urls))
    for t in (g.urls, g.contents, g.links):
        sizes = [r.size for r in t.committed()]
        assert len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)


def test_waits_are_forgotten_by_a_timer(spark):
    from spindex.streaming.wait_stream import load_waits, run_wait_stream
    t0 = dt.datetime(2024, 1, 1)
    rules = spark.createDataFrame([], "host_key STRING, robots STRUCT<rate_limit: DOUBLE, rules: ARRAY<STRUCT<idx: INT, allow: BOOLEAN, path: STRING>>>")
    src, state = scratch_dir(spark, "waits-src"), scratch_dir(spark, "waits-state")

    def drain(k, rows, **more):
        full = [(u, True, 200, {}, "x", True, t0 + dt.timedelta(minutes=m), 0) for u, m in rows]
        spark.createDataFrame(full, RESPONSES).coalesce(1).write.parquet(f"{src}/{k}")
        run_wait_stream(spark, f"{src}/*/*.parquet", rules, state, **more)
        return {r["host_key"]: r["fetched_at"] for r in load_waits(spark, state).collect()}

    a, b = "https://a.example.com", "https://b.example.com"
    got = drain(0, [(a + "/1", 5), (a + "/2", 3), (b + "/1", 1)])
    assert got == {a: t0 + dt.timedelta(minutes=5), b: t0 + dt.timedelta(minutes=1)}
    got = drain(1, [(a + "/3", 4), (b + "/2", 2)])  # older for a, newer for b
    assert got == {a: t0 + dt.timedelta(minutes=5), b: t0 + dt.timedelta(minutes=2)}
    from spindex.streaming.wait_stream import waits_log
    assert waits_log(spark, state).of_batch(1).count() == 1  # only what changed is written


def test_the_state_of_a_host_is_dropped_after_its_time():
    from spindex.streaming.wait_stream import HostWaits
    import pandas as pd

    class Value:
        now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, x):
            self.now = x

        def clear(self):
            self.now = None

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), []

        def getValueState(self, *_):
            return self.value

        def listTimers(self):
            return list(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    h, p = Handle(), HostWaits(forget_ms=1000)
    p.init(h)
    frame = pd.DataFrame({"host_key": ["a", "a"], "fetched_us": [5_000_000, 2_000_000], "next_allowed_us": [6_000_000, 9_000_000]})
    assert len(list(p.handleInputRows(("a",), iter([frame]), None))) == 1
    assert h.value.now == (6_000_000, 5_000_000) and h.timers == [7000]
    assert list(p.handleInputRows(("a",), iter([frame]), None)) == []  # nothing new
    later = frame.assign(fetched_us=[8_000_000, 7_000_000])
    assert len(list(p.handleInputRows(("a",), iter([later]), None))) == 1 and h.timers == [9000 - 2000 + 2000]
    assert list(p.handleExpiredTimer(("a",), None, None)) == [] and not h.value.exists()


def test_a_recrawled_page_has_its_last_terms_alone(spark):
    from spindex.streaming.index_stream import StreamedIndex, load_index
    schema = "page_id BIGINT, page_url STRING, page_content STRING, chunk BIGINT"
    index = StreamedIndex(spark, scratch_dir(spark, "segments-test"))
    index.add_segment(spark.createDataFrame([(1, "u1", "alpha alpha bravo", 0), (2, "u2", "alpha", 0), (3, "u3", None, 0)], schema), 0)
    index.add_segment(spark.createDataFrame([(1, "u1", "alpha charlie", 0), (4, "u4", "bravo", 0)], schema), 1)
    index.add_segment(spark.createDataFrame([(1, "u1", "delta", 0), (1, "u1", "echoes", 0)], schema), 2)
    want = {("alpha", 2): 1, ("bravo", 4): 1, ("echoes", 1): 1}
    for _ in range(2):
        assert {(r["term"], r["page_id"]): r["occurrences"] for r in index.counts().collect()} == want
        assert {r["page_id"] for r in index.urls().collect()} == {1, 2, 4}
        index.compact()
        for table in (index.counts_log, index.tf_log, index.ended_log):
            table.compact(least=2, growth=100)
    terms, _ = load_index(spark, index.folder)
    assert {r["term"]: r["total_pages"] for r in terms.collect()} == {"alpha": 1, "bravo": 1, "echoes": 1}


def plain_generations(rounds, capacity, keep):
    kept, sizes, out = {}, [0], []
    for urls in rounds:
        if sizes[-1] >= capacity:
            sizes.append(0)
        now = len(sizes) - 1
        fresh = {u for u in urls if u is not None and kept.get(u, -10 ** 9) <= now - keep}
        out += fresh
        sizes[-1] += len(fresh)
        kept.update(dict.fromkeys(fresh, now))
    return sorted(out)


@pytest.mark.parametrize("capacity,keep", [(6, 2), (1, 1), (1000, 3)])
def test_a_url_is_forgotten_with_its_generation(spark, capacity, keep):
    from spindex.streaming.seen_stream import emitted_urls, run_seen_generations
    rng = random.Random(capacity)
    rounds = [[rng.choice([None] + [f"u{i}" for i in range(14)]) for _ in range(7)] for _ in range(6)]
    src, out = scratch_dir(spark, "gen-src"), scratch_dir(spark, "gen-out")
    for k, urls in enumerate(rounds):
        spark.createDataFrame([(u,) for u in urls], "url STRING").coalesce(1).write.parquet(f"{src}/{k}")
        run_seen_generations(spark, f"{src}/*/*.parquet", out, capacity, keep)
    assert sorted(r["url"] for r in emitted_urls(spark, out).collect()) == plain_generations(rounds, capacity, keep)
