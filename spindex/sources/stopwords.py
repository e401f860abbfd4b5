"""Stopword source: the fixed list, or a one-word-per-line text file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.functions.constants import STOPWORD_LINES


def stopword_set() -> frozenset:
    return frozenset(w.strip() for w in STOPWORD_LINES if w.strip())


def stopwords_df(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Distinct stopwords as ``(word STRING)``.

    With ``path`` the list is read by Spark (``spark.read.text``), stripped and
    de-duplicated; otherwise the packaged list is used.
    """
    if path is not None:
        lines = spark.read.text(path)
        return (lines.select(F.trim(F.col("value")).alias("word"))
                .where(F.col("word") != "").distinct())
    rows = [(w,) for w in sorted(stopword_set())]
    return spark.createDataFrame(rows, "word STRING")
