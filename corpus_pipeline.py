"""A corpus preparation pipeline over ``documents``: five stages, each one operator of ``spindex.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before it kept; ``run`` writes each stage's result to the shared
checkpoint folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.llm import bpe, decontam, langid, lshforest, pii
from spindex.llm.common import prepare, table
from spindex.llm.queries import tokenizer_path
from spindex.session import materialize

# A text whose mean longest match is shorter than this under its best language is in none of them.
MIN_MATCH_BYTES = 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language: no letter at all, or phrases hardly longer than a byte.

    Learned from the labelled rows of ``documents`` in ``sf_dir``, so the decision about a row does
    not hang on which other rows came in.
    """
    prepare(spark)
    model = langid.fit(table(spark, sf_dir, "documents"))
    judged = langid.identify(docs, model, out="__language")
    known = (F.col("__language.lang_pred") != langid.UND) & (F.col("__language.match_length") >= MIN_MATCH_BYTES)
    return judged.where(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, that of the smallest id."""
    prepare(spark)
    return lshforest.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    prepare(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind; ``n_chars`` follows the new text."""
    prepare(spark)
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts and decode the ids: ``doc_id, lang, source, n_chars, n_tokens, ids`` (little-endian
    unsigned 32-bit integers), and the SHA-256 digests of the library's decoding and of the text that the
    incremental byte-to-text machine restores."""
    prepare(spark)
    coded = docs.withColumn("__bpe", bpe.round_trip_digests(F.col("text"), tokenizer_path()))
    return coded.select("doc_id", "lang", "source", "n_chars", "__bpe.n_tokens", "__bpe.ids", "__bpe.decoded_sha256", "__bpe.restored_sha256")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("bpe", tokens),
]

# The language model, the MinHash forest, the bootstrapped patterns and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
