"""Ranked search (P3) against stored index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.constants import TOP_K
from spindex.operators import search as se
from spindex.operators.pruned import top_k
from spindex.plans.index_build import SearchIndex, term_bucket


def query_buckets(queries: DataFrame, buckets: int) -> list[int]:
    """Term buckets a query batch touches: at most ``buckets`` small
    integers, so collecting them is bounded whatever the data size."""
    vocab = se.query_term_counts(queries).select(term_bucket("term", buckets).alias("b")).distinct()
    return sorted(r["b"] for r in vocab.collect())


def search_index(queries: DataFrame, index: SearchIndex, k: int = TOP_K, prune: bool = False) -> DataFrame:
    """Top ``k`` per query reading only stored tables: the dictionary rows
    and postings of the query terms, their term frequencies, the URLs.
    Term-keyed tables are read only in the buckets of the batch's terms
    (partition pruning at the scan)."""
    b = query_buckets(queries, index.buckets)
    pick = F.col("term_bucket").isin(b)
    terms = index.terms.where(pick).drop("term_bucket")
    postings = index.postings.where(pick).drop("term_bucket")
    tf_all = index.tf.where(pick).drop("term_bucket")
    weights = se.materialize(se.query_term_weights(queries, terms, index.n_pages))
    asked = weights.select("term").distinct()
    tf = tf_all.join(asked, "term", "left_semi")
    if prune:
        return top_k(weights, postings, tf, index.urls, k)
    if index.rows is not None:  # of terms that the dictionary does not hold, the occurrences are no postings
        kept = asked.join(terms.select("term", F.lit(1).cast("bigint").alias("_kept")), "term", "left")
        if asked.count() <= se.BROADCAST_TERMS:
            kept = F.broadcast(kept)
        evidence = index.rows.where(pick).join(kept, "term") \
            .withColumn("occurrences", F.col("occurrences") * F.coalesce("_kept", F.lit(0))).drop("_kept", "term_bucket")
    else:
        evidence = se.evidence_of(postings.join(asked, "term", "left_semi"), tf)
    return se.top_k_per_query(se.score_candidates(weights, evidence, index.urls, k), k)
