"""Contract queries of the operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindex.llm import (anchors, ann, bpe, credentials, decontam, divergence, langid, lshforest, pii, sharding, tokencount,
                         toxicity, urlfilter)
from spindex.llm.common import prepare, table
from spindex.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    _REGISTRY[fn.__name__] = run
    return run


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def in_fold(id_col: str, mod: int, remainder: int):
    return F.crc32(F.col(id_col).cast("string")) % mod == remainder


@register
def op1_language_id(spark, sf_dir):
    """Language of every document by cross-parsing; learned from the documents not held out."""
    docs = table(spark, sf_dir, "documents")
    held = in_fold("doc_id", 5, 0)
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", "text"), model) \
        .select("doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.match_length")


@register
def op2_decontamination(spark, sf_dir):
    """Overlaps of all documents with all benchmark items."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_md5")


def _count(spans: str, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


@register
def op3_pii(spark, sf_dir):
    """Base and discovered personal data of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, keep=["doc_id"])
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.span_string(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_string(F.col("spans")).alias("spans"))


@register
def op4_nearest(spark, sf_dir):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, rows.where("vec_id % 50 = 0"))


@register
def op5_bpe(spark, sf_dir):
    """Encode and decode every document; digests of the real ids and texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", "bpe.n_tokens", F.sha2(F.col("bpe.ids"), 256).alias("ids_sha256"),
                        F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"),
                        F.sha2(F.col("bpe.restored").cast("binary"), 256).alias("restored_sha256"))


@register
def op6_ngram_jaccard_join(spark, sf_dir):
    """Near-duplicate class and verified links of every document."""
    return lshforest.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


@register
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document; the labels of the held-out fold are never seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    labels = table(spark, sf_dir, "labels").where(~in_fold("doc_id", 3, 1))
    classifier = toxicity.fit(docs, labels, model)
    return toxicity.score(docs, model, classifier) \
        .select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "toxicity.score", "toxicity.predicted")


@register
def op8_secrets(spark, sf_dir):
    """Secrets of every document: strong parts, and weak ones linked with complementary parts."""
    found = credentials.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(credentials.STRONG)]
    return found.select("doc_id", *counts, F.sha2(credentials.span_string(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        credentials.span_string(F.col("spans")).alias("spans"))


@register
def op9_token_counts(spark, sf_dir):
    """Tokens of every document, counted in flat token files written from all texts."""
    return tokencount.document_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op10_url_filter(spark, sf_dir):
    """Verdict on the URL of every page."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), keep=["page_id"])


@register
def op11_vector_codes(spark, sf_dir):
    """Codes, errors and codebooks of all usable embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    done = anchors.compress(rows, keep=["vec_id", "label"])
    coded = materialize(done.rows, "vector-codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    books = F.sha2(F.lit(anchors.codebook_text(done.codebooks)).cast("binary"), 256)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left") \
        .select("vec_id", "code", "error", "label_error", books.alias("codebooks_sha256"))


@register
def op12_source_divergence(spark, sf_dir):
    """Divergence of all pairs of sources of each language, and the terms that set a source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@register
def op13_sharding(spark, sf_dir):
    """All documents in eight shards, each with the mixture of sources of the whole."""
    dealt = sharding.interleave(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
