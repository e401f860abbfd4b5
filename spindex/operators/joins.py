"""Join shapes for "small batch against a big stored table".

Spark plans ``batch LEFT ANTI JOIN table`` with the table as the build
side, so the stored table is shuffled on every batch.  Turning it around —
first find the batch keys that exist (``table LEFT SEMI JOIN batch``, where
the batch is the build side and AQE broadcasts it when it is measured
small), then anti-join the batch against those few keys — keeps the stored
table a streamed scan.  When the batch is not small AQE falls back to a
sort-merge join with skew splitting; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def existing(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct key rows of ``batch`` that occur in ``table``."""
    probe = batch.select(*keys).distinct()
    return table.select(*keys).join(probe, keys, "left_semi").distinct()


def missing_from(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose keys do not occur in ``table``."""
    return batch.join(existing(table, batch, keys), keys, "left_anti")
