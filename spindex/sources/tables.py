"""Readers for the input tables.

Every reader states its schema (no inference) and returns a lazy DataFrame;
column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
DOCUMENTS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
BENCHMARK_SCHEMA = "item_id BIGINT, text STRING"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The scan as it is, unless the session sets ``spark.spindex.scanPartitions``:
    then its rows are hash-spread on ``key`` over so many partitions (for
    inputs of a single large row group, whose text work would run in one task)."""
    n = int(df.sparkSession.conf.get("spark.spindex.scanPartitions", "0"))
    return df.repartition(n, key) if n else df


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages ``(page_id, url, html)``."""
    return spread(read_table(spark, sf_dir, "pages", PAGES_SCHEMA), "page_id")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents", DOCUMENTS_SCHEMA), "doc_id")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark", BENCHMARK_SCHEMA)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a page relation ``(page_id, page_url, page_content)``.

    Documents carry no URL; ``doc/<id>`` stands in so the URL boost has a
    well-defined input.
    """
    d = read_documents(spark, sf_dir)
    return d.select(F.col("doc_id").alias("page_id"),
                    F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("page_url"),
                    F.col("text").alias("page_content"))
