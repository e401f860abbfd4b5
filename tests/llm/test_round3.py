"""Vector codes, source divergence and sharding against brute force, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindex.llm import anchors, common, divergence, queries, sharding, sql

SF = "/root/testdata/sf0.001"
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


@pytest.fixture(scope="module")
def sp(spark):
    return common.prepare(spark)


def twin_rows(name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = con.sql(sql.oracle_sql()[name])
    return r.columns, r.fetchall()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_source_divergence", "op13_sharding"])
def test_query_equals_its_twin(sp, name):
    got = queries.registry()[name](sp, SF)
    columns, rows = twin_rows(name)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(rows)


# --- 11 vector codes ------------------------------------------------------------------

def plain_codes(rows, entries=16, rounds=6):
    """The rounds as stated, over Python integers: id order, codes, errors and codebooks."""
    rows = sorted(rows)
    points = [[math.floor(4096 * x) for x in v] for _, v in rows]
    width = len(points[0]) // 8 if points else 0
    books, codes = [], []
    for p in range(8):
        mine = [x[p * width:(p + 1) * width] for x in points]
        book = [list(x) for x in mine[:entries]]

        def nearest(x):
            return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(x, book[e])), e))

        for _ in range(rounds):
            groups = defaultdict(list)
            for x in mine:
                groups[nearest(x)].append(x)
            for e, xs in groups.items():
                book[e] = [sum(col) // len(xs) for col in zip(*xs)]
        books.append(book)
        codes.append([(e := nearest(x), sum((a - b) ** 2 for a, b in zip(x, book[e]))) for x in mine])
    return {r[0]: ("".join(f"{codes[p][i][0]:02x}" for p in range(8)), sum(codes[p][i][1] for p in range(8)))
            for i, r in enumerate(rows)}, books


def test_a_walk_over_the_tree_equals_all_distances():
    rng = np.random.default_rng(5)
    shapes = [rng.normal(0, 500, (700, 4)), np.repeat(rng.normal(0, 5, (9, 3)), 60, axis=0),
              np.cumsum(np.abs(rng.normal(0, 90, (300, 1))), axis=0), rng.integers(0, 3, (500, 2)).astype(float), np.zeros((40, 2)),
              np.exp(rng.uniform(0, 20, (200, 2)))]
    for raw in shapes:
        points = np.floor(raw)
        tree = anchors.build_tree(points)
        assert sorted(tree.order) == list(range(len(points)))
        for a, b, left, right, pivot, radius, total in zip(tree.start, tree.end, tree.left, tree.right, tree.pivot, tree.radius, tree.total):
            own = points[tree.order[a:b]]
            assert (np.sqrt(((own - pivot) ** 2).sum(1)) <= radius * (1 + 1e-9) + 1e-9).all() and (own.sum(0) == total).all()
            if left >= 0:
                assert (tree.start[left], tree.end[left], tree.start[right], tree.end[right]) == (a, tree.end[left], tree.end[left], b)
        entries = np.concatenate([points[:7], points[:2], points[-7:]])  # with equal entries
        code, sums, counts, compared = anchors.assign(tree, points, entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (code == want).all()
        for e in range(len(entries)):
            assert counts[e] == (want == e).sum() and (sums[e].astype(float) == points[want == e].sum(0)).all()
        assert compared <= len(points)


def test_far_clusters_are_owned_without_a_look_at_their_points():
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 10_000, (16, 4))
    points = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 3, (4000, 4)))
    _, _, counts, compared = anchors.assign(anchors.build_tree(points), points, np.floor(centres))
    assert counts.sum() == 4000 and compared < 200


@pytest.mark.parametrize("block", [4096, 50])
def test_codes_equal_the_plain_rounds(sp, monkeypatch, block):
    monkeypatch.setattr(anchors, "BLOCK_ROWS", block)
    rng = random.Random(8)
    base = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, [float(np.float32(x)) for x in (base[0] if i % 3 == 0 else rng.choice(base))], i % 4) for i in range(300)]  # a third are copies
    done = anchors.compress(sp.createDataFrame(rows, VECTORS).repartition(3))
    want, books = plain_codes([(r[0], r[1]) for r in rows])
    assert done.codebooks == books
    assert {r["vec_id"]: (r["code"], r["error"]) for r in done.rows.collect()} == want


def test_codes_of_odd_rows(sp):
    nan, inf = float("nan"), float("inf")
    rows = [(4, [1.0] * 8, None), (2, [0.5] * 8, 1), (2, [-0.5] * 8, 1), (None, [2.0] * 8, 1), (5, None, 1), (6, [nan] * 8, 1), (7, [inf] * 8, 1),
            (8, [None] + [1.0] * 7, 1), (9, [1.0] * 16, 1), (10, [], 1), (11, [1e30] * 8, 1), (12, [3e12] * 8, 2)]
    table = sp.createDataFrame(rows, VECTORS).withColumn("code", F.lit("x")).withColumn("v", F.lit(1)).withColumn("id", F.lit(1))
    done = anchors.compress(table, keep=["vec_id", "label"])
    got = sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in done.rows.collect()), key=str)
    assert [r[0] for r in got] == [12, 2, 2, 4, None]
    assert all(r[3] == 0 for r in got)  # fewer rows than entries: each is its own entry
    assert done.codebooks[0][:3] == [[-2048], [2048], [4096]] and done.codebooks[0][4] == [8192]
    five = sp.createDataFrame([(i, [0.1 * i] * 5, None) for i in range(3)], VECTORS)
    assert [len(p[0]) for p in anchors.compress(five).codebooks] == [1] * 8
    none = anchors.compress(table.where("false"))
    assert none.codebooks == [[]] * 8 and none.rows.count() == 0
    empties = anchors.compress(sp.createDataFrame([(1, [], None), (2, [], None)], VECTORS))
    assert [(r["code"], r["error"]) for r in empties.rows.collect()] == [("00" * 8, 0)] * 2


def test_large_integers_stay_exact(sp):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(1 << 20)) + 0.25 * (i % 3) for _ in range(8)], None) for i in range(80)]
    want, books = plain_codes([(r[0], r[1]) for r in rows])
    done = anchors.compress(sp.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT"))
    assert done.codebooks == books and {r["vec_id"]: (r["code"], r["error"]) for r in done.rows.collect()} == want


# --- 12 source divergence ---------------------------------------------------------------

def plain_audit(rows, min_docs):
    """Dense: every pair of sources, every kept term."""
    import re
    words = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    docs = [(r[2] or "", r[3] or "", words.findall((r[1] or "").translate(low))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)

        def shares(words):
            c = Counter(w for w in words if w in df and df[w] >= min_docs)
            n = sum(c.values())
            return c, {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        groups = {s: shares([w for d in mine if d[1] == s for w in d[2]]) for s in {d[1] for d in mine}}
        whole = shares([w for d in mine for w in d[2]])[1]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (c, p) in groups.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, (_, q) in groups.items() if o != s]
            terms = [(t, f(p[t], whole[t])) for t in kept if c[t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)}
    return out


def test_audit_equals_a_dense_count(sp):
    rng = random.Random(12)
    vocabulary = ["Apple", "bärte", "İx", "l'eau", "été", "ZEBRA", "a", "日本", "x1y", "K"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(160):
        text = None if i % 40 == 0 else " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["s", "S", "é", "", None, "t"]), 0))
    rows += [(None, "Apple apple ZEBRA copy", "en", s, 0) for s in ["s"] * 60 + ["t"] * 3]  # a third are copies
    rows += [(7, "one", "xx", "only", 0), (7, "", "yy", "s", 0), (7, "zz", "yy", "t", 0), (9, "long " * 30_000, "en", "s", 0)]
    table = sp.createDataFrame(rows, DOCS).withColumn("term", F.lit("x")).withColumn("digest", F.lit("x")).repartition(5)
    for least in (1, 10):
        got = [tuple(r) for r in divergence.audit(table, min_docs=least).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_audit(rows, least)
    assert divergence.audit(table.where("false")).count() == 0


def test_terms_of_texts_end_to_end():
    import re
    import pyarrow as pa
    texts = ["Ab c", "", "d", None, "É-é_x", "z", "日本 go", "1"]
    want = [dict(Counter(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower().decode()))) for t in texts]
    got = divergence.count_terms(pa.array(texts)).to_pylist()
    assert [{p["term"]: p["times"] for p in row} for row in got] == want
    assert divergence.count_terms(pa.array([None, ""], pa.string())).to_pylist() == [[], []]


def test_each_text_of_a_language_is_tokenized_once(sp):
    rows = [(i, "same text", "en", f"s{i % 3}", 0) for i in range(30)] + [(99, "same text", "de", "s0", 0)]
    texts = sp.createDataFrame(rows, DOCS).select("lang", "source", "text")
    copies, counts = divergence.collapsed_counts(texts)
    assert sorted((r["lang"], r["source"], r["n"]) for r in copies.collect()) == [("de", "s0", 1)] + [("en", f"s{k}", 10) for k in range(3)]
    assert {(r["lang"], r["source"], r["term"]): (r["docs"], r["times"]) for r in counts.collect()}["en", "s1", "same"] == (10, 10)


# --- 13 sharding ------------------------------------------------------------------------

def test_shards_are_equal_gapless_and_mixed(sp):
    rng = random.Random(13)
    sources = ["hot"] * 40 + ["a"] * 20 + ["b", None, ""] * 5 + ["rare"]
    rows = [(i if i % 50 else None, None if i % 31 == 0 else "é" * (i % 7), "en", rng.choice(sources), 0) for i in range(1500)]
    rows += [(3, "copy", "en", "hot", 0)] * 700
    table = sp.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("size", F.lit("x")).withColumn("kept", F.lit(1)).repartition(6)
    got = sharding.interleave(table, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    per_shard = Counter(r["shard"] for r in got)
    assert sorted(per_shard) == list(range(8)) and max(per_shard.values()) - min(per_shard.values()) <= 1
    for shard, n in per_shard.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    mix = Counter((r["shard"], r["source"]) for r in got)
    for source, n in Counter(r[3] for r in rows).items():  # every shard has its share of every source
        assert all(abs(mix[s, source] - n / 8) < 2 for s in range(8))
    hot = [r for r in got if r["source"] == "hot"]
    in_order = sorted(hot, key=lambda r: r["position"])
    keys = [hashlib.md5(f"13:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest() for r in in_order]
    assert keys == sorted(keys)  # shuffled by the seeded hash


def test_few_rows_and_other_seeds(sp):
    rows = [(i, "t", None, None, 0) for i in range(3)]
    got = sharding.interleave(sp.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["slot"] for r in got) == [0, 0, 0] and len({r["shard"] for r in got}) == 3
    assert sharding.interleave(sp.createDataFrame([], DOCS)).count() == 0
    many = sp.createDataFrame([(i, "t", None, "s", 0) for i in range(100)], DOCS)
    orders = [[r["doc_id"] for r in sharding.interleave(many, seed=s).orderBy("position").collect()] for s in ("1", "1", "2")]
    assert orders[0] == orders[1] != orders[2]
