"""N-gram Jaccard join by a MinHash LSH forest.

Method.  A text is the set of its ``SHINGLE``-word runs.  ``trees`` labels of
``depth`` MinHash values each put a set into as many prefix tries, kept as
sorted label tables: two sets meet in a tree at depth ``d`` if their labels
share a prefix of ``d`` values, which for Jaccard ``s`` has probability
``s ** d``.  Prefixes are shortened from the full label until the recall at the
threshold, ``1 - (1 - s ** d) ** trees``, reaches ``recall``.  At each depth
every set is paired with the most central set under its prefix (the one with
the most company over all trees), so a group of n copies costs n - 1 pairs.
All pairs are verified exactly on the texts; the verified ones are joined to
classes.  Where sets of *different* classes still share a prefix of the least
depth, the sets outside the prefix's largest class are compared with all sets
of other classes there, until no new link appears.  Of these pairs, the ones
whose signatures agree in clearly fewer values than the threshold asks for
(``SLACK`` standard errors) are not verified.  Last, the links inside the
classes are counted: all sets of a class are compared with each other, in
blocks of ``BLOCK`` sets whose common shingles are counted by a matrix product,
and only each set's number of links leaves the task.

Sets that are equal (texts that differ in case or punctuation only) are one
node, whatever their number.

Result: one row per document: its id, ``class_id`` (the smallest id in its
class), ``n_links`` (the other sets of its class that reach the threshold with
its own) and ``copies`` (documents with an equal set).

Defined cases: texts without a word are compared as whole texts (equal ones
form a class; null counts as empty); texts of fewer than ``SHINGLE`` words are
one run; rows with a null id take part, and are a class's smallest only if all
ids in it are null; repeated rows get a row each; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.llm.common import cuts, utf8
from spindex.llm.graph import components
from spindex.llm.words import mix, shingles, word_hashes
from spindex.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.99
BATCH_BYTES = 1 << 20
SLACK = 2.5
BLOCK = 256             # sets of a class compared with as many others in one go
BLOCK_BYTES = 1 << 22   # or fewer, so that their shingles stay about this small
_SLICE = 4096  # columns of the matrix product at a time
_STEP = 4096  # shingles hashed by all functions at a time
_VALUE = 4    # bytes of a label value


def stop_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix whose expected recall at the threshold reaches the target."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    raise ValueError("too few trees for this recall")


def _functions(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(hashes: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Top 32 bits of the smallest product with each odd multiplier."""
    low = np.full(len(mult), np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(hashes), _STEP):
        part = hashes[a:a + _STEP]
        np.minimum(low, (mult[:, None] * part[None, :]).min(1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signature_column(text, trees: int, depth: int, size: int):
    """Struct ``(set BINARY, labels ARRAY<BINARY>)``; ``set`` identifies the shingle set (128 bits),
    it is null and there are no labels for a text without words."""

    @F.arrow_udf("struct<set:binary,labels:array<binary>>")
    def signed(texts: pa.Array) -> pa.Array:
        mult = _functions(trees * depth)
        sets, labels = [], []
        buf, offsets = utf8(texts)
        for a, b in cuts(offsets, BATCH_BYTES):
            words, at = word_hashes(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            for i in range(b - a):
                s = shingles(words[at[i]:at[i + 1]], size)
                if not len(s):
                    sets.append(None)
                    labels.append([])
                    continue
                spread = mix(s)
                key = np.array([s.sum(dtype=np.uint64), spread.sum(dtype=np.uint64) ^ np.uint64(len(s))], ">u8")
                sets.append(key.tobytes())
                low = minhash(spread, mult).astype(">u4").tobytes()
                labels.append([low[k:k + _VALUE * depth] for k in range(0, len(low), _VALUE * depth)])
        return pa.StructArray.from_arrays(
            [pa.array(sets, pa.binary()), pa.array(labels, pa.list_(pa.binary()))], ["set", "labels"])

    return signed(F.lower(text))


def shingles_column(text, size: int):
    """The shingle set of a text: its 64-bit hashes, sorted, as bytes."""

    @F.arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        out = []
        buf, offsets = utf8(texts)
        for a, b in cuts(offsets, BATCH_BYTES):
            words, at = word_hashes(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            out += [shingles(words[at[i]:at[i + 1]], size).tobytes() for i in range(b - a)]
        return pa.array(out, pa.binary())

    return sets(F.lower(text))


def jaccard_column(a, b):
    """Exact Jaccard similarity of two shingle sets (0 if both are empty)."""

    @F.arrow_udf("double")
    def similar(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs, ys):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            either = len(x) + len(y) - both
            out.append(both / either if either else 0.0)
        return pa.array(out, pa.float64())

    return similar(a, b)


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those ``pairs (a, b)``, b < a, whose sets reach the threshold; ``sets (key, shingles)``."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    found = pairs.join(left, "a").join(right, "b")
    return found.withColumn("similarity", jaccard_column(F.col("sa"), F.col("sb"))) \
        .where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def partners(xs: list[np.ndarray], ys: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per set of ``xs`` the sets of ``ys`` that reach the threshold with it, and the other way round;
    without ``ys``: the other sets of ``xs``, and nothing."""
    flat = np.concatenate(xs)
    if ys is None:
        values, n = np.unique(flat, return_counts=True)
        values = values[n > 1]
    else:
        values = np.intersect1d(flat, np.concatenate(ys))

    def cells(sets):
        rows, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(values, flat)
        known = at < len(values)
        known[known] = values[at[known]] == flat[known]
        order = np.argsort(at[known], kind="stable")
        return rows[known][order], at[known][order]

    def matrix(rows, at, n, low, high):
        a, b = np.searchsorted(at, (low, high))
        out = np.zeros((n, high - low), np.float32)
        out[rows[a:b], at[a:b] - low] = 1
        return out

    left = cells(xs)
    right = left if ys is None else cells(ys)
    others = xs if ys is None else ys
    both = np.zeros((len(xs), len(others)))
    for low in range(0, len(values), _SLICE):
        high = min(low + _SLICE, len(values))
        x = matrix(*left, len(xs), low, high)
        both += x @ (x if ys is None else matrix(*right, len(ys), low, high)).T
    either = np.array([len(s) for s in xs])[:, None] + np.array([len(s) for s in others])[None, :] - both
    same = both / np.maximum(either, 1) >= threshold
    if ys is None:
        np.fill_diagonal(same, False)
        return same.sum(1), np.zeros(0, np.int64)
    return same.sum(1), same.sum(0)


def _count_links(links: DataFrame, root: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(key, n_links)`` of every set with a link: all sets of its class that reach the threshold with it.

    Classes of which every pair is a verified link are counted from the links.  The sets of the others
    are dealt over blocks by a hash; each pair of blocks is one group.
    """
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    known = degree.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = materialize(known, "forest-degree")
    classes = known.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_links").alias("ends"))
    unsettled = materialize(classes.where("ends < n * (n - 1)").select("root"), "forest-unsettled")
    members = known.join(unsettled, "root").select("root", "key").join(sets, "key")
    parts = members.groupBy("root").agg(F.expr(f"greatest(ceil(count(*) / {BLOCK}), ceil(sum(length(shingles)) / {BLOCK_BYTES}))").alias("parts"))
    parts = materialize(parts, "forest-parts")
    dealt = members.join(parts, "root").withColumn("block", F.expr("pmod(xxhash64(key), parts)")) \
        .withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "shingles")

    def count(group: pa.Table) -> pa.Table:
        block = group.column("block").to_numpy()
        shingle = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        first, last = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        x, y = np.flatnonzero(block == first), np.flatnonzero(block == last)
        n = np.zeros(len(block), np.int64)
        if len(x) and len(y):
            n[x], back = partners([shingle[k] for k in x], None if first == last else [shingle[k] for k in y], threshold)
            if first != last:
                n[y] = back
        return pa.table({"key": group.column("key"), "n_links": pa.array(n)})

    counted = dealt.groupBy("root", "i", "j").applyInArrow(count, "key binary, n_links bigint")
    counted = counted.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    settled = known.join(unsettled, "root", "left_anti").select("key", "n_links")
    return settled.union(counted)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
         threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
         count_links: bool = True) -> DataFrame:
    """One row per document: ``id_col, class_id, n_links, copies, text_md5``; ``n_links`` is null if not counted."""
    least = stop_depth(threshold, trees, depth, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("md5"))
    signed = base.withColumn("sig", signature_column(F.col("text"), trees, depth, size))
    # a text without words stands for itself
    rows = materialize(signed.select("id", "md5", F.coalesce("sig.set", "md5").alias("key"), "sig.labels"), "forest-rows")
    one = "struct(id IS NULL, id, md5)"
    keys = materialize(rows.groupBy("key").agg(F.expr(f"min({one})").alias("first"), F.count("*").alias("copies"),
                                               F.expr("any_value(labels)").alias("labels")), "forest-keys")

    # the tries: sets that share a prefix of the least depth with another set
    node = keys.select("key", F.posexplode("labels").alias("tree", "label"))
    node = node.withColumn("prefix", F.expr(f"substring(label, 1, {_VALUE * least})"))
    crowd = node.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    trie = materialize(node.join(crowd, ["tree", "prefix"]), "forest-trie")
    company = trie.groupBy("key").agg(F.sum("n").alias("company"))
    ranked = trie.select("tree", "label", "key").join(company, "key")

    pairs = None
    for d in range(depth, least - 1, -1):
        cut = ranked.withColumn("prefix", F.expr(f"substring(label, 1, {_VALUE * d})"))
        middle = cut.groupBy("tree", "prefix").agg(F.expr("max(struct(company, key)).key").alias("b"))
        met = cut.join(middle, ["tree", "prefix"]).where("key <> b") \
            .select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b"))
        pairs = met if pairs is None else pairs.union(met)
    pairs = materialize(pairs.distinct(), "forest-pairs")

    # the sets that meet another one, read off one text each
    some = trie.select("key").distinct().join(keys, "key").select("key", F.col("first.md5").alias("md5"), F.col("first.id").alias("id"))
    chosen = base.alias("d").join(some.alias("s"), F.expr("d.md5 = s.md5 AND d.id <=> s.id"))
    sets = chosen.select("s.key", shingles_column(F.col("d.text"), size).alias("shingles"))
    sets = materialize(sets.dropDuplicates(["key"]), "forest-sets")

    links = materialize(_verify(pairs, sets, threshold), "forest-links")
    tried = pairs
    while True:
        root = materialize(components(links), "forest-root")
        more = _between(trie, root, keys, threshold, depth, least).join(tried, ["a", "b"], "left_anti")
        more = materialize(more, "forest-between")
        if more.isEmpty():
            break
        found = materialize(_verify(more, sets, threshold), "forest-links")
        tried = tried.union(more)
        if found.isEmpty():
            break
        links = links.union(found)

    none = F.lit(0 if count_links else None).cast("bigint")
    named = keys.select("key", "first", "copies").join(root, "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    if count_links:
        named = named.join(materialize(_count_links(links, root, sets, threshold), "forest-counts"), "key", "left")
    else:
        named = named.withColumn("n_links", none)
    classes = named.groupBy("root").agg(F.min("first").alias("class"))
    named = named.join(classes, "root").select("key", F.col("class.id").alias("class_id"), F.col("class.md5").alias("class_md5"),
                                               F.coalesce("n_links", none).alias("n_links"), "copies")
    return rows.select("id", "md5", "key").join(named, "key") \
        .select(F.col("id").alias(id_col), "class_id", "n_links", "copies", F.col("md5").alias("text_md5"), "class_md5")


def _values(labels):
    """The MinHash values of all labels of a set, as integers."""

    @F.arrow_udf("array<int>")
    def values(rows: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(b"".join(r), ">i4").astype(np.int32) for r in rows.to_pylist()], pa.list_(pa.int32()))

    return values(labels)


def _between(trie: DataFrame, root: DataFrame, keys: DataFrame, threshold: float, depth: int, least: int) -> DataFrame:
    """Pairs ``(a, b)``, b < a, of sets of different classes that share a prefix of the least depth
    and whose signatures do not speak against the threshold.

    The largest class under a prefix never meets itself here, however many of its sets are there.
    """
    own = trie.select("tree", "prefix", "key").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = own.groupBy("tree", "prefix", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("tree", "prefix").agg(F.count("*").alias("classes"), F.expr("max(struct(n, root)).root").alias("main")) \
        .where("classes > 1").drop("classes")
    own = own.join(mixed, ["tree", "prefix"])
    signed = own.select("key").distinct().join(keys.select("key", "labels"), "key").select("key", _values("labels").alias("sig"))
    own = materialize(own.join(signed, "key"), "forest-mixed")
    here = own.where("root <> main").select("tree", "prefix", "root", F.col("key").alias("x"), F.col("sig").alias("sx"))
    there = own.select("tree", "prefix", F.col("root").alias("other"), F.col("main").alias("of"), F.col("key").alias("y"), F.col("sig").alias("sy"))
    agree = "size(filter(zip_with(sx, sy, (p, q) -> p = q), e -> e))"
    enough = f"size(sx) * {threshold} - {SLACK} * sqrt(size(sx) * {threshold * (1 - threshold)})"
    # a pair is made once: by its first common prefix, and if both are outside the largest class, one way round
    earlier = f"exists(sequence(0, h.tree), t -> t < h.tree AND slice(sx, t * {depth} + 1, {least}) = slice(sy, t * {depth} + 1, {least}))"
    pairs = here.alias("h").join(there.alias("t"), F.expr(
        "h.tree = t.tree AND h.prefix = t.prefix AND h.root <> t.other AND (t.other = t.of OR h.x > t.y) "
        f"AND {agree} >= {enough} AND NOT {earlier}"))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row per class: its smallest id (of equal rows, one)."""
    joined = join(docs, id_col, text_col, count_links=False, **options)
    kept = joined.select(F.col("class_id").alias("__id"), F.col("class_md5").alias("__md5")).distinct()
    marked = docs.withColumn("__md5", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = marked.alias("d").join(kept.alias("k"), F.expr(f"d.__md5 = k.__md5 AND d.`{id_col}` <=> k.__id"), "left_semi")
    return rows.dropDuplicates(["__md5", id_col]).select(*docs.columns)
