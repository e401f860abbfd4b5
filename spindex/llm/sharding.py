"""Sharding by proportional stratified interleaving.

Method.  The rows of each source are shuffled by a seeded hash and ranked; row
r of a source with n rows gets the fractional rank (2r + 1) / (2n).  All rows
sorted by it interleave the sources in their proportions, and cutting that
order into equal consecutive pieces gives shards whose row counts are at most
one apart (law ``rows``) and which all hold the mixture of the whole.

Only ids, sources, sizes and hashes are shuffled, never texts.  Both orders come
from distributed sorts with per-partition offsets (``operators.ordering``): a
source that holds a third of all rows is spread over many tasks by its hash.
Ranks inside a source are global positions less the source's first position, so
no task holds a source and no table of all sources is gathered.

Result of ``interleave``: the rows' ``keep`` columns, ``source``, ``size``,
``text_crc32``, ``position`` (0-based), ``shard`` and ``slot`` (0-based, gapless
within the shard).

Defined cases: null text counts no bytes (size 1, crc 0); null sources are a
stratum of their own, apart from empty ones; null or repeated ids are rows like
others; fractional ranks are compared to 18 digits, ties go by source, then by
hash; rows that agree in all of id, text checksum, size and source are
interchangeable; fewer rows than shards leave the later cuts empty; an empty
table gives no rows; further columns of the input, whatever their names, take no
part unless they are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindex.operators.ordering import with_global_position

SHARDS = 8
SEED = "13"
LAW = "rows"


def shuffle_key(id_col: Column, seed: str = SEED) -> Column:
    """The seeded order of a source's rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def fraction(rank: Column, rows: Column) -> Column:
    """(2 rank + 1) / (2 rows), in units of 10^-18, rounded down."""
    wide = ((F.lit(2) * rank + 1).cast("decimal(19,0)") * F.lit(10 ** 18).cast("decimal(19,0)")).alias("wide")
    return F.call_function("div", wide, (F.lit(2) * rows).cast("decimal(19,0)"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Deal every row into one of ``shards`` pieces, each with the mixture of the whole."""
    keep = [id_col] if keep is None else keep
    body = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(F.struct(*keep).alias("kept"), F.col(source_col).alias("source"), shuffle_key(F.col(id_col), seed).alias("key"),
                        (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    ties = ["key", "text_crc32", "size"]
    sorted_rows = with_global_position(light, ["source", *ties], "place")
    starts = sorted_rows.groupBy(F.col("source").alias("of")).agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    ranked = sorted_rows.join(starts, F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("fraction", fraction(F.col("place") - F.col("first"), F.col("rows"))) \
        .select("kept", "source", "size", "text_crc32", "key", "fraction")
    dealt = with_global_position(ranked, ["fraction", "source", *ties], "position")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    n, at = F.lit(shards), F.col("position")
    shard = F.call_function("div", at * n, F.col("total"))
    # the first position of a shard: the smallest p with p * shards div total = shard
    first = F.call_function("div", shard * F.col("total") + n - 1, n)
    return dealt.crossJoin(F.broadcast(total)) \
        .select("kept.*", "source", "size", "text_crc32", "position", shard.cast("int").alias("shard"), (at - first).alias("slot"))
