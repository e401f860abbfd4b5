"""Source divergence audit: how far the sources of each language differ in their words.

Method.  Duplicate-text collapse: identical texts of a language become one text
with a multiplicity per source.  Each distinct text is tokenized once; its terms
meet the multiplicities, and weighted document frequencies and counts are added
per (lang, source, term).  Terms in fewer than ``MIN_DOCS`` documents of the
language are left out.

Exact shares.  A group gives each of the language's V kept terms, with count
occurrences among the N of all kept terms, p = 1 + floor(10^9 (count + 2) / (N + 2 V)).
The divergence of two shares is f(p, q) = floor((p - q)^2 / (p + q)).

Sparse pair evaluation.  Most terms are absent from most sources, where the share
is one value p0 per group.  With s, t the sets of terms present in two sources

    sum over V of f = V f(p0s, p0t) + sum over s of [f(p, p0t) - f(p0s, p0t)]
                      + sum over t of [f(p0s, q) - f(p0s, p0t)]
                      + sum over both of [f(p, q) - f(p, p0t) - f(p0s, q) + f(p0s, p0t)]

so the second and third sums come from a histogram of a source's shares, and only
terms that two sources share are paired (added up in the task that pairs them).

Texts are shuffled once, by their digest (equal ones collapse before); the copies
of a text that is a third of all rows are counts by then.  A (lang, term) has as many rows as it
has sources, never as many as its documents.

Result of ``audit``: ``lang, source, part, item, value, rank``.

Defined cases: null text, lang and source are empty strings; groups without terms
take part in pairs (with p0 only); a language without kept terms has V = 0, its
pairs have the value 0 and it has no term rows; a source alone in its language has
no pairs; ties in value go by the item's UTF-8 bytes; an empty table gives no rows;
other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindex.llm.common import utf8
from spindex.session import materialize

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HELD = 1_000_000  # (group, term) sums in a task's memory


def split_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of UTF-8 texts laid end to end, and the number of the text that each is from.

    A term is a run of letters and of bytes above 127 (a code point above 127 has no other bytes), so
    what is left of the bytes without the rest is all terms side by side.
    """
    small = data | 0x20
    inside = (data >= 0x80) | ((small >= ord("a")) & (small <= ord("z")))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]  # a term ends with its text
    kept = np.where(data < 0x80, small, data)[inside]
    at = np.flatnonzero(first)
    starts = np.append(np.cumsum(inside)[at] - 1, len(kept)).astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return terms, np.searchsorted(offsets, at, "right") - 1


def count_terms(texts: pa.Array) -> pa.Array:
    """The distinct terms of each text with their numbers of occurrences."""
    data, offsets = utf8(texts)
    terms, of = split_terms(data, offsets)
    coded = terms.dictionary_encode()
    width = max(1, len(coded.dictionary))
    found, times = np.unique(of * width + coded.indices.to_numpy(), return_counts=True)
    of, code = np.divmod(found, width)
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64())], ["term", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32()), pairs)


def weighted_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(lang, source, n, digest, text)`` -> partial ``(lang, source, term, docs, times)`` of a task.

    Rows of one text stand side by side, so it is tokenized once (again where a batch ends).  Sums are
    kept for up to ``HELD`` (group, term) pairs and then given out.
    """
    ids: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []

    def summed(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["group", "term"], use_threads=False).aggregate([("docs", "sum"), ("times", "sum")])
        return out.rename_columns(["group", "term", "docs", "times"])

    def given(table: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array([key[i] for key in ids], pa.string()) for i in (0, 1))
        named = pa.table({"lang": pc.take(langs, table["group"]), "source": pc.take(sources, table["group"]),
                          "term": table["term"], "docs": table["docs"], "times": table["times"]})
        yield from named.combine_chunks().to_batches(max_chunksize=65_536)

    for batch in batches:
        if not len(batch):
            continue
        keys = zip(batch["lang"].to_pylist(), batch["source"].to_pylist())
        group = np.array([ids.setdefault(k, len(ids)) for k in keys], np.int32)
        digests = batch["digest"].to_pylist()
        new = np.array([i == 0 or digests[i] != digests[i - 1] for i in range(len(digests))])
        lists = count_terms(batch["text"].filter(pa.array(new))).take(pa.array(np.cumsum(new) - 1))
        row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
        n = batch["n"].to_numpy()[row]
        flat = lists.flatten()
        held.append(summed([pa.table({"group": group[row], "term": flat.field("term"), "docs": n,
                                      "times": n * flat.field("times").to_numpy()})]))
        if sum(map(len, held)) > 2 * HELD:
            held = [summed(held)]
            if len(held[0]) > HELD:
                yield from given(held.pop())
    if held:
        yield from given(summed(held))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly."""
    top = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * kept).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares stay below 2^30, so nothing overflows."""
    return F.call_function("div", (p - q) * (p - q), p + q)


COUNTS = "lang STRING, source STRING, term STRING, docs BIGINT, times BIGINT"


def collapsed_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts (lang, source, text)`` -> the multiplicities ``(lang, digest, source, n)`` and
    ``(lang, source, term, docs, times)``, the texts of a language tokenized once each."""
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    copies = materialize(texts.groupBy("lang", digest, "source").agg(F.count("*").alias("n")), "copies")
    # equal texts collapse in the reading task, then by the key that the join needs too: texts move once, and the
    # join leaves the sources of a text side by side
    once = texts.select("lang", digest, "text").dropDuplicates(["lang", "digest"])
    joined = once.join(copies, ["lang", "digest"]).select("lang", "source", "n", "digest", "text")
    partial = joined.mapInArrow(weighted_counts, COUNTS)
    # summed per task before; dealt by (lang, term), which the sums per source and those per language both can use
    counts = partial.repartition("lang", "term").groupBy("lang", "source", "term") \
        .agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    return copies, counts


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Divergence of all pairs of sources of a language, and each source's most over-used terms."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    copies, counts = collapsed_counts(texts)
    of_term = Window.partitionBy("lang", "term")  # as many rows as the term has sources
    kept = counts.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_times": F.sum("times").over(of_term),
                               "one": (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")}) \
        .where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")
    kept = materialize(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("one").alias("v"), F.sum("times").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    groups = copies.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "v", "lang_total"])
    groups = materialize(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", share(F.col("times"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_times"), F.col("lang_total"), F.col("v")).alias("q"))
    shares = materialize(shares, "shares")
    return _pairs(groups, shares).union(_terms(shares, top_terms))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return shares.where("p > q").withColumn("value", gap(F.col("p"), F.col("q"))).withColumn("rank", rank) \
        .where(F.col("rank") <= top) \
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows made: sources^2 per language (as many as the result has), a histogram's rows per pair, shared terms."""
    s, t = groups.select("lang", "source", "p0", "v"), groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    absent = s.join(t, "lang").where("source < other") \
        .select("lang", "source", "other", (F.col("v") * gap(F.col("p0"), F.col("q0"))).alias("f"))
    # of the terms that a source has, what they add against a source that has none of them
    many = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    alone = many.join(t, "lang").where("source <> other").select(
        "lang", F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other"),
        (F.col("m") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("f"))
    mine = shares.select("lang", "term", "source", "p0", "p")
    theirs = shares.select("lang", "term", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("p").alias("q"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = mine.join(theirs, ["lang", "term"]).where("source < other") \
        .select("lang", "source", "other", (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("f"))
    sums = [x.groupBy("lang", "source", "other").agg(F.sum("f").alias("f")) for x in (absent, alone, both)]
    value = sums[0].union(sums[1]).union(sums[2]).groupBy("lang", "source", "other").agg(F.sum("f").alias("value"))
    value = materialize(value, "pair-values")
    each = value.union(value.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
    return each.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))
