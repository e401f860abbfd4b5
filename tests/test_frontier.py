"""Domain interleave, fetch batches and global positions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spindex.operators.frontier import interleave
from spindex.operators.ordering import with_global_position


def _urls(sizes):
    out = {}
    for d, n in sizes.items():
        out[f"{d}.com"] = [f"http://{d}.com/{i:03d}" for i in range(n)]
    return out


# sizes, exit_domains -> URLs in the order they are dealt (domain and number)
ORDERS = [
    ({"a": 5}, 0, "a0 a1 a2 a3 a4"), ({"a": 5, "b": 3}, 0, "a0 b0 a1 b1 a2 b2 a3 a4"),
    ({"a": 4, "b": 4, "c": 4, "d": 2}, 0, "a0 b0 c0 d0 a1 b1 c1 d1 a2 b2 c2 a3 b3 c3"),
    ({"a": 5}, 2, "a0 a1 a2 a3 a4"), ({"a": 5, "b": 3}, 2, "a0 b0 a1 b1 a2 b2 a3 a4"),
    ({"a": 5, "b": 3, "c": 1}, 2, "a0 b0 c0"), ({"a": 4, "b": 4, "c": 4, "d": 2}, 2, "a0 b0 c0 d0 a1 b1 c1 d1 a2 b2 c2 a3 b3 c3"),
    ({"a": 7, "b": 1, "c": 1}, 2, "a0 b0 c0"),
]


@pytest.mark.parametrize("sizes,exit_domains,order", ORDERS)
def test_interleave(spark, sizes, exit_domains, order):
    by_domain = _urls(sizes)
    rows = [(u,) for us in by_domain.values() for u in us] + [(by_domain["a.com"][0],)]  # a duplicate
    batches, leftover = interleave(spark.createDataFrame(rows, "url STRING"), batch_size=3, exit_domains=exit_domains)
    want = [f"http://{x[0]}.com/{int(x[1:]):03d}" for x in order.split()]
    got = sorted((r["batch_id"], r["pos"], r["url"]) for r in batches.collect())
    assert got == [(i // 3, i % 3, u) for i, u in enumerate(want)]
    assert {r["url"] for r in leftover.collect()} == {u for us in by_domain.values() for u in us} - set(want)


def test_politeness_acts_inside_a_batch(spark):
    import datetime as dt
    from spindex.plans.frontier import prepare_frontier
    by_domain = _urls({"a": 8, "b": 8, "c": 8})
    urls = spark.createDataFrame([(u,) for us in by_domain.values() for u in us], "url STRING")
    later = dt.datetime(2024, 1, 1, 0, 0, 2)
    waits = spark.createDataFrame([("http://a.com", later)], "host_key STRING, next_allowed_at TIMESTAMP")
    from spindex.operators.politeness import defer_by_politeness
    planned, _ = interleave(urls, batch_size=3)
    # two seconds of wait: one URL in a batch may go (2 < 3), two may not
    one = defer_by_politeness(planned, waits, "2024-01-01 00:00:00", ["batch_id"])
    assert one.where("deferred").count() == 0
    planned, _ = interleave(urls, batch_size=6)
    two = defer_by_politeness(planned, waits, "2024-01-01 00:00:00", ["batch_id"])
    assert {r["url"] for r in two.where("deferred").collect()} == set(by_domain["a.com"])
    f = prepare_frontier(urls, urls.where("false"), waits, _rules(spark), "2024-01-01 00:00:00", batch_size=6)
    assert (f.batches.count(), f.deferred.count(), f.disallowed.count(), f.leftover.count()) == (16, 8, 0, 0)


def _rules(spark):
    from spindex.catalog import robots_table
    return robots_table(spark, "/root/testdata/sf0.001")


def test_global_position_equals_row_number(spark):
    random.seed(7)
    rows = [(random.randint(0, 50), f"k{random.randint(0, 999):04d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a INT, b STRING, id INT").repartition(7)
    got = {r["id"]: r["pos"] for r in with_global_position(df, ["a", "b", "id"]).collect()}
    w = Window.orderBy("a", "b", "id")
    want = {r["id"]: r["p"] - 1 for r in df.select("id", F.row_number().over(w).alias("p")).collect()}
    assert got == want


def test_interleave_options(spark):
    by_domain = _urls({"a": 5, "b": 3, "c": 1, "d": 1})
    df = spark.createDataFrame([(u,) for us in by_domain.values() for u in us], "url STRING")
    everything, left = interleave(df, batch_size=4)
    order = [r["url"][7] + r["url"][-1] for r in sorted(everything.collect(), key=lambda r: (r["batch_id"], r["pos"]))]
    assert order == "a0 b0 c0 d0 a1 b1 a2 b2 a3 a4".split() and left.count() == 0
    two, rest = interleave(df, batch_size=4, exit_domains=0, max_domains=2)
    assert {r["domain"] for r in two.collect()} == {"a.com", "b.com"}
    assert {r["domain"] for r in rest.collect()} == {"c.com", "d.com"}


def test_interleave_with_a_hot_domain(spark):
    by_domain = {"hot.com": [f"http://hot.com/{i:04d}" for i in range(600)]}
    for d in range(300):
        by_domain[f"s{d:03d}.com"] = [f"http://s{d:03d}.com/{i}" for i in range(4)]
    df = spark.createDataFrame([(u,) for us in by_domain.values() for u in us], "url STRING").repartition(8)
    batches, leftover = interleave(df, batch_size=50)
    assert leftover.count() == 0
    rows = batches.collect()
    assert sorted((r["batch_id"], r["pos"]) for r in rows) == [(i // 50, i % 50) for i in range(1800)]
    rounds = {}
    for r in rows:
        rounds.setdefault(r["round"], []).append(r["domain"])
    # the first four rounds take one URL of every domain, the rest only the hot one's
    assert [len(set(rounds[k])) for k in range(1, 601)] == [301] * 4 + [1] * 596
    assert all(len(v) == len(set(v)) for v in rounds.values())
