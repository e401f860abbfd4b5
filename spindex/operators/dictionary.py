"""Persistent dictionaries: dense ids for keys, carried from batch to batch.

A dictionary is an append-only table ``id, key`` (``sources.log_table``).  The keys of a
batch that it lacks get the next ids in key order, after those given out before: ids are
gapless, never change, and no two keys share one.  Positions come from a distributed sort
with per-partition offsets (``operators.ordering``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.operators.ordering import with_global_position
from spindex.session import materialize as write_once
from spindex.sources.log_table import LogTable


@dataclass(frozen=True)
class Dictionary:
    log: LogTable

    def next_id(self, before: int | None = None) -> int:
        top = self.log.rows(before).agg(F.max("id").alias("m")).first()["m"]
        return 0 if top is None else top + 1

    def placed(self, keys: DataFrame, batch: int, next_id: int) -> tuple[DataFrame, DataFrame]:
        """``keys(key, ...)``, one row per key -> the known ones as ``(id, key)``, and the new ones with their
        columns and ``id``.  Nothing is stored yet."""
        known = self.log.rows(batch)
        if self.log.runs(batch):  # the stored table is scanned, the batch is the side that may be broadcast
            known = write_once(known.join(keys.select("key"), "key", "left_semi").select("id", "key"), "known-keys")
        new = with_global_position(keys.join(known.select("key"), "key", "left_anti"), ["key"], "n")
        return known, new.withColumn("id", (F.col("n") + next_id).cast("bigint")).drop("n")

    def extend(self, keys: DataFrame, batch: int) -> DataFrame:
        """Store what is new of ``keys(key)`` (repeats and nulls do not matter) and return ``(id, key)`` of all of them."""
        named = keys.select(F.col(keys.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
        known, new = self.placed(named, batch, self.next_id(batch))
        self.log.append(new, batch)
        return known.unionByName(self.log.of_batch(batch).select("id", "key"))


def new_dictionary(spark: SparkSession, name: str, folder: str | None = None) -> Dictionary:
    from spindex.streaming.state import scratch_dir
    return Dictionary(LogTable(spark, folder or scratch_dir(spark, f"{name}-dictionary"), "id BIGINT, key STRING", "key"))
