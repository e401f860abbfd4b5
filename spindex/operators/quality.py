"""Integrity report: the table constraints Spark does not enforce, checked
as queries (one row per rule with the number of violating rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key (a unique / primary-key check)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("checked"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row (a foreign-key check)."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    missing = child.select(key).join(p, key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    total = child.agg(F.count(F.lit(1)).alias("checked"))
    return missing.crossJoin(total)  # two one-row aggregates


def nulls(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).cast("bigint").alias("violations"),
                  F.count(F.lit(1)).alias("checked"))


def integrity_report(checks: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations, checked)`` from named one-row check frames."""
    rows = [c.select(F.lit(name).alias("rule"), F.col("violations").cast("bigint").alias("violations"),
                     F.col("checked").cast("bigint").alias("checked"))
            for name, c in checks.items()]
    return reduce(DataFrame.unionByName, rows)
