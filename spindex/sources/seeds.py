"""Seed URLs: one per line, stripped, blanks dropped, grouped into batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.functions.constants import SEED_BATCH_SIZE
from spindex.operators.ordering import with_global_position


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, value)`` of a seed text file; line order is file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def seed_batches(lines: DataFrame, batch_size: int = SEED_BATCH_SIZE) -> DataFrame:
    """``(batch_id, slot, url, batch_order)``: consecutive non-blank lines in
    groups of ``batch_size``.  ``batch_order`` is a deterministic hash order
    standing in for a random shuffle of the batches."""
    urls = lines.select("line_no", F.regexp_replace("value", r"^(?U)\s+|(?U)\s+$", "").alias("url")).where(F.col("url") != "")
    pos = with_global_position(urls, ["line_no"])
    b = F.floor(F.col("pos") / F.lit(batch_size)).cast("bigint")
    return pos.select(b.alias("batch_id"), F.pmod(F.col("pos"), F.lit(batch_size)).cast("bigint").alias("slot"),
                      "url", F.xxhash64(b).alias("batch_order"))
