"""Index build (P2) as written tables.

scan -> index-side tokens -> filters -> dictionary + postings, plus the
query-side term frequencies and the page count that ranked search reads.
Each table is written once under a caller-given folder (or the checkpoint
folder) so query batches never rescan the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.text import keep_index_term, keep_rare_term, query_terms
from spindex.operators import index as ix
from spindex.operators.counts import page_counts, split_shared
from spindex.session import at_once, materialize


ROWS_PER_BUCKET = 2_000_000  # postings of a term bucket, about
MOST_BUCKETS = 4096


def bucket_count(postings: int) -> int:
    """Term buckets of an index with so many postings: a query reads those of its terms alone."""
    return max(16, min(MOST_BUCKETS, -(-postings // ROWS_PER_BUCKET)))


def term_bucket(col, buckets: int):
    """Partition key of the stored index: a hash bucket of the term."""
    return F.pmod(F.xxhash64(F.col(col) if isinstance(col, str) else col), F.lit(buckets)).cast("int")


@dataclass
class SearchIndex:
    terms: DataFrame      # term_id, term, total_pages, term_bucket
    postings: DataFrame   # term, page_id, term_bucket
    tf: DataFrame         # page_id, term, tf_count, doc_len, term_bucket (query tokenizer)
    n_pages: DataFrame    # one row: n_pages
    urls: DataFrame       # page_id, page_url
    buckets: int
    rows: DataFrame | None = None  # postings before the rare-term rule and tf, as index_rows, term_bucket


def all_term_frequencies(corpus: DataFrame) -> DataFrame:
    """Query-tokenizer counts for every (page, term): the stored form of
    :func:`spindex.operators.search.term_frequencies`."""
    toks = (corpus.where(F.col("page_content").isNotNull())
            .select("page_id", query_terms("page_content").alias("toks")))
    x = toks.select("page_id", F.size("toks").cast("bigint").alias("doc_len"),
                    F.explode("toks").alias("term"))
    return x.groupBy("page_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf_count"))


def index_rows(corpus: DataFrame, stopwords=None) -> DataFrame:
    """``(term, page_id, doc_len, tf_count, occurrences)``: postings (``occurrences`` above 0, before the rare-term rule)
    and term frequencies (``tf_count`` above 0) in one row per (term, page); apart for page ids that several pages share."""
    keep = keep_index_term("term", stopwords)
    columns = ["term", "page_id", "doc_len", "tf_count", "occurrences"]
    one, several = split_shared(corpus)

    def kept(pages: DataFrame) -> DataFrame:
        x = page_counts(pages).withColumn("occurrences", F.when(keep, F.col("occurrences")).otherwise(F.lit(0).cast("bigint")))
        return x.where("tf_count > 0 OR occurrences > 0").select(*columns)

    if several is None:
        return kept(one)
    x, none = kept(several), F.lit(0).cast("bigint")
    tf = x.where("tf_count > 0").groupBy("page_id", "term", "doc_len").agg(F.sum("tf_count").alias("tf_count")).withColumn("occurrences", none)
    held = x.where("occurrences > 0").groupBy("page_id", "term").agg(F.sum("occurrences").alias("occurrences")) \
        .withColumn("doc_len", none).withColumn("tf_count", none)
    return kept(one).unionByName(tf.select(*columns)).unionByName(held.select(*columns))


def build_search_index(corpus: DataFrame, stopwords=None, buckets: int | None = None, dictionary=None, batch: int = 0) -> SearchIndex:
    """Write the index tables; postings and term frequencies lie in one of them, so that the text is read
    once and its terms shuffled once.  Term-keyed tables are partitioned by a term
    hash bucket (their number follows the postings') so a query batch reads only
    the buckets of its terms.  Term ids are those of ``dictionary`` (kept over
    rebuilds; a new one by default)."""
    # by term inside a task, so that what is alike lies together when it is written and shuffled
    counted = materialize(index_rows(corpus, stopwords).sortWithinPartitions("term", "page_id"), "page-terms")
    stats = ix.term_statistics(counted.where("occurrences > 0"))
    terms = stats.where(keep_rare_term("term", "occurrences")).select("term", F.col("pages").alias("total_pages"))
    terms = materialize(terms, "kept-terms")
    buckets = buckets or bucket_count(terms.agg(F.sum("total_pages")).first()[0] or 0)
    terms = ix.number_terms(terms, dictionary, batch)

    def by_term(df: DataFrame, name: str):  # row-group statistics on the term skip what a lookup does not need
        return lambda: materialize(df.withColumn("term_bucket", term_bucket("term", buckets)), name, ["term_bucket"], ["term"])

    terms, rows, n_pages, urls = at_once(
        by_term(terms, "terms"), by_term(counted, "index-rows"),
        lambda: materialize(ix.page_count(corpus), "n-pages"), lambda: materialize(corpus.select("page_id", "page_url"), "urls"))
    postings = rows.where("occurrences > 0").join(terms.select("term_bucket", "term"), ["term_bucket", "term"], "left_semi") \
        .select("term", "page_id", "term_bucket")
    tf = rows.where("tf_count > 0").select("page_id", "term", "tf_count", "doc_len", "term_bucket")
    return SearchIndex(terms, postings, tf, n_pages, urls, buckets, rows)
