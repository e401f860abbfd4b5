"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.session import materialize

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges (a, b)``, any orderable key type -> ``(key, root)`` for every key that is no root;
    the root is the smallest key of its component.

    Each round points the larger neighbours of every node, then its smaller ones, at the smallest
    neighbour; minima are pre-aggregated before the shuffle, and a node with very many neighbours
    is one row on the other side of a join that adaptive execution splits.  The tables of a round
    are written to the shared checkpoint folder.  Rounds go up with the logarithm of a component's
    diameter; running out of ``MAX_ROUNDS`` raises an error.
    """
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct(), "cc")
    last = _sign(pairs)
    for _ in range(MAX_ROUNDS):
        if not last[0]:
            return pairs.select(F.col("u").alias("key"), F.col("v").alias("root"))
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(low.select("u", "m")).where("u <> v").distinct()
        pairs = materialize(small, "cc")
        now = _sign(pairs)
        if now == last:
            return pairs.select(F.col("u").alias("key"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _sign(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
