"""Benchmark decontamination by spaced-seed hashing.

Method.  A spaced seed is a fixed mask over a few consecutive words; the
words at its 0 positions are ignored, so a passage with substituted words still
hits where the substitutions fall on ignored positions of some mask.  Seeds of
benchmark and training texts are hashed and joined.  Around each hit the two
texts are laid side by side on its diagonal and compared word by word: the
stretch grows in both directions while substitutions stay within a drop-off.
A stretch of at least ``MIN_WORDS`` words (or the whole item, if the item is
shorter), of which ``MIN_SHARE`` agree, is an overlap.

The masks leave no gap: every overlap of ``MIN_WORDS`` to 24 words, wherever its
substitutions fall, holds a hit of some mask (the tests go through all of them), as
does an exact copy of a shorter item.  Items under ``MIN_WORDS`` words have masks over
the whole item besides, for the accepted substitutions that no common mask hits.

The training side is one pass over the texts.  Seeds that cannot be in the
benchmark are left out there by a bit table of fixed size (``BITS``), the only
thing broadcast; the rest is joined with the benchmark's seeds by hash.  The
verification is per document and diagonal, so a passage that very many
documents share stays spread over them.

Result: one row per document and benchmark passage (an ``item_id`` with a text) with
an overlap: the id, ``item_id``, word positions ``doc_start`` and ``doc_end`` (exclusive),
``n_words``, ``n_equal`` of the longest overlap (ties: the first).

Defined cases: null texts are empty; items without a word mark nothing; repeated documents give
their rows each; equal passages of one id count once, different passages of one
id are searched each and give a row each; an empty table on either side gives no
rows; rows with null ids, of documents or items, are kept with null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.llm.common import cuts, utf8
from spindex.llm.words import mix, word_hashes
from spindex.session import materialize

# 1: the word counts; 0: any word.
MASKS = ("110111", "1101000011", "100001111", "11111")
MIN_WORDS = 13
MIN_SHARE = 0.75
DROP = 4.0     # a stretch ends where its score falls this far below its best
MISMATCH = 2.0  # score of a differing word: minus this; of an equal one: plus one
BITS = 24      # log2 of the bit table's size (2 MB)
BATCH_BYTES = 1 << 20


def seed_hashes(words: np.ndarray, mask: str, nth: int) -> np.ndarray:
    """Hash of the words that a mask selects, at every start position."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # words are hashes already: a sum with odd multipliers, mixed once
    h = np.full(n, np.uint64(nth + 1))
    for i, c in enumerate(mask):
        if c == "1":
            h += words[i:i + n] * np.uint64(2 * pow(7, i + 1, 1 << 40) + 1)
    return mix(h)


def _bench_seeds(items: DataFrame, masks, extra: dict[int, list[tuple[int, str]]]) -> DataFrame:
    """``(seed, item, ipos, whole)`` of every item and mask; ``whole`` is the number of words of an item for
    which ``extra`` has masks, if the seed is by one of them, else 0."""

    @F.arrow_udf("array<struct<seed:bigint,ipos:int,whole:int>>")
    def seeds(texts: pa.Array) -> pa.Array:
        buf, offsets = utf8(texts)
        words, at = word_hashes(buf, offsets)
        out = []
        for i in range(len(texts)):
            w = words[at[i]:at[i + 1]]
            used = [(0, k, m) for k, m in enumerate(masks)] + [(len(w), k, m) for k, m in extra.get(len(w), [])]
            out.append([{"seed": int(h), "ipos": p, "whole": whole} for whole, k, m in used
                        for p, h in enumerate(seed_hashes(w, m, k).view(np.int64))])
        return pa.array(out, pa.list_(pa.struct([("seed", pa.int64()), ("ipos", pa.int32()), ("whole", pa.int32())])))

    rows = items.select("item", F.explode(seeds(F.lower("text"))).alias("s"))
    return rows.select("s.seed", "item", "s.ipos", "s.whole")


def missed(n: int, masks, min_words: int, min_share: float) -> list[str]:
    """The accepted overlaps of ``n`` words, of an item of as many, that no mask hits: 1 an equal word, 0 another."""
    out, item = [], np.arange(n, dtype=np.uint64)
    for wrong in range(int(n * (1 - min_share)) + 1):
        for at in combinations(range(1, n - 1), wrong):
            equal = np.ones(n, bool)
            equal[list(at)] = False
            hit = any(all(equal[s + i] for i, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1))
            best = None if hit else _best(np.where(equal, item, n), item, [0], min_words, min_share)
            if best and best["n_words"] == n:
                out.append("".join("01"[int(e)] for e in equal))
    return out


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """A table of 2**BITS bits with the bit of each benchmark seed set; at most 2**(BITS - 6) rows are collected."""
    slot = F.shiftrightunsigned("seed", 64 - BITS)
    words = seeds.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, CAST(pmod({0}, 64) AS INT))".format(
        f"shiftrightunsigned(seed, {64 - BITS})")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    table = np.zeros(1 << (BITS - 6), np.int64)
    for r in words:
        table[r["w"]] = r["b"]
    return np.unpackbits(table.view(np.uint8), bitorder="little").view(bool)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, min_words: int = MIN_WORDS,
             min_share: float = MIN_SHARE) -> DataFrame:
    """The overlaps, plus ``text_md5`` of the document's text (for joins that do not trust the id)."""
    spark = docs.sparkSession
    other = F.coalesce(F.col(item_text_col), F.lit(""))
    passages = benchmark.select(F.unhex(F.md5(other)).alias("item"), F.col(item_col).alias("name"), other.alias("text"))
    names = materialize(passages.select("item", "name").distinct(), "decontam-names")
    items = materialize(passages.select("item", "text").dropDuplicates(["item"]), "decontam-items")
    extra = {n: [(1000 * n + k, m) for k, m in enumerate(missed(n, masks, min_words, min_share))] for n in range(1, min_words)}
    seeds = materialize(_bench_seeds(items, masks, extra), "decontam-seeds")
    lengths = sorted(r["whole"] for r in seeds.where("whole > 0").select("whole").distinct().collect())  # all below min_words
    numbered = [*enumerate(masks), *[x for n in lengths for x in extra[n]]]
    bits = spark.sparkContext.broadcast(_bit_table(seeds))

    @F.arrow_udf("array<struct<seed:bigint,pos:int>>")
    def candidates(texts: pa.Array) -> pa.Array:
        table = bits.value
        seed, pos, count = [], [], np.zeros(len(texts), np.int64)
        buf, offsets = utf8(texts)
        for a, b in cuts(offsets, BATCH_BYTES):
            words, at = word_hashes(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            found = []
            for k, m in numbered:
                h = seed_hashes(words, m, k)
                p = np.flatnonzero(table[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                row = np.searchsorted(at, p, "right") - 1
                inside = p + len(m) <= at[row + 1]  # a seed lies in one text
                found.append((p[inside], h[p[inside]], row[inside]))
            p, h, row = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(row, kind="stable")
            seed.append(h[order].view(np.int64))
            pos.append((p - at[row])[order].astype(np.int32))
            count[a:b] += np.bincount(row, minlength=b - a)
        ends = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
        both = pa.StructArray.from_arrays([pa.array(np.concatenate([*seed, np.zeros(0, np.int64)])),
                                           pa.array(np.concatenate([*pos, np.zeros(0, np.int32)]))], ["seed", "pos"])
        return pa.ListArray.from_arrays(ends, both)

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("md5"))
    hits = base.select("id", "md5", F.explode(candidates(F.lower("text"))).alias("c")) \
        .select("id", "md5", "c.seed", "c.pos").join(seeds.drop("whole"), "seed")
    # of the hits of a document on one diagonal, where to begin comparing: the stretches are found from all of them
    lines = hits.select("id", "md5", "item", (F.col("pos") - F.col("ipos")).alias("shift")).distinct()
    lines = lines.groupBy("id", "md5", "item").agg(F.sort_array(F.collect_list("shift")).alias("shifts"))
    lines = materialize(lines, "decontam-lines")

    texts = base.alias("d").join(lines.select("id", "md5").alias("l"),
                                 F.expr("d.md5 = l.md5 AND d.id <=> l.id"), "left_semi").dropDuplicates(["md5", "id"])
    sides = lines.alias("l").join(texts.alias("d"), F.expr("d.md5 = l.md5 AND d.id <=> l.id")) \
        .select("l.id", "l.md5", "l.item", "l.shifts", "d.text").join(items.select("item", F.col("text").alias("other")), "item")

    @F.arrow_udf("struct<doc_start:int,doc_end:int,n_words:int,n_equal:int>")
    def longest(xs: pa.Array, ys: pa.Array, shifts: pa.Array) -> pa.Array:
        out = []
        xb, xo = utf8(xs)
        yb, yo = utf8(ys)
        xw, xa = word_hashes(xb, xo)
        yw, ya = word_hashes(yb, yo)
        for i, ss in enumerate(shifts.to_pylist()):
            out.append(_best(xw[xa[i]:xa[i + 1]], yw[ya[i]:ya[i + 1]], ss, min_words, min_share))
        return pa.array(out, pa.struct([(n, pa.int32()) for n in ("doc_start", "doc_end", "n_words", "n_equal")]))

    found = sides.withColumn("o", longest(F.lower("text"), F.lower("other"), F.col("shifts"))).where("o IS NOT NULL")
    found = found.select("id", "md5", "item", "o.*").join(names, "item")
    rows = base.select("id", "md5").alias("d").join(found.alias("f"), F.expr("d.md5 = f.md5 AND d.id <=> f.id"))
    return rows.select(F.col("d.id").alias(id_col), F.col("f.name").alias(item_col), "doc_start", "doc_end", "n_words",
                       "n_equal", F.col("d.md5").alias("text_md5"))


def stretches(equal: np.ndarray, mismatch: float = MISMATCH, drop: float = DROP) -> list[tuple[int, int]]:
    """Maximal stretches of a comparison that tolerate substitutions: they start and end with an equal
    word, and no part of them falls ``drop`` below the best score so far."""
    out, i, n = [], 0, len(equal)
    at = np.flatnonzero(equal)
    while i < len(at):
        start = end = at[i]
        score = best = 1.0
        j = i + 1
        while j < len(at):
            score += 1 - mismatch * (at[j] - at[j - 1] - 1)
            if score < best - drop or score <= 0:
                break
            if score >= best:
                best, end = score, at[j]
            j += 1
        out.append((int(start), int(end) + 1))
        i = max(i + 1, int(np.searchsorted(at, end, "right")))
    return out


def _best(doc: np.ndarray, item: np.ndarray, shifts: list[int], min_words: int, min_share: float):
    best = None
    need = min(min_words, len(item))
    for shift in shifts:
        a, b = max(0, shift), min(len(doc), len(item) + shift)
        if b - a < need:
            continue
        equal = doc[a:b] == item[a - shift:b - shift]
        for s, e in stretches(equal):
            same = int(equal[s:e].sum())
            if e - s >= need and same >= min_share * (e - s) and (best is None or e - s > best["n_words"]):
                best = {"doc_start": a + s, "doc_end": a + e, "n_words": e - s, "n_equal": same}
    return best


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item."""
    bad = overlaps(docs, benchmark, id_col, text_col, **options).select("text_md5").distinct()
    marked = docs.withColumn("__md5", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    return marked.join(bad.withColumnRenamed("text_md5", "__md5"), "__md5", "left_anti").select(*docs.columns)
