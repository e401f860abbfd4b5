"""Inverted index: scan, tokenize, filter, term dictionary, postings, df.

Plan shape (one index build):

    scan(page_id, page_content)            -- Parquet scan, content IS NOT NULL pushed
      -> explode(index_terms)              -- narrow, per page
      -> filter (stopwords/length/vowels)  -- narrow
      -> groupBy(term, page_id) count     -- partial aggregation per map task, so
                                              only distinct (term, page) pairs shuffle
      -> groupBy(term) sum/count           -- partial aggregation again; hot terms
                                              collapse map-side
      -> rare-term rule -> semi join       -- AQE turns it into a broadcast when the
                                              kept dictionary is measured small
    The (term, page) counts are written once and read by both branches, so
    the text is scanned and tokenized a single time.

A term is identified by itself; what needs numbers takes dense ids from a persistent
dictionary (``operators.dictionary``), in which no two terms can meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindex.functions.text import index_terms, keep_index_term, keep_rare_term
from spindex.operators.joins import missing_from
from spindex.session import materialize

POSTING_BLOCK = 1024  # page ids per posting block, on average


def number_terms(terms: DataFrame, dictionary=None, batch: int = 0, spark=None) -> DataFrame:
    """``terms`` with a dense ``term_id``: those of ``dictionary`` (a new one by default), which new terms extend."""
    from spindex.operators.dictionary import new_dictionary
    d = dictionary or new_dictionary(spark or terms.sparkSession, "terms")
    ids = d.extend(terms.select("term"), batch)
    return terms.join(ids.select(F.col("id").alias("term_id"), F.col("key").alias("term")), "term").select("term_id", *terms.columns)


def scan_indexable(corpus: DataFrame) -> DataFrame:
    """Pages that have content (an empty string counts, null does not)."""
    return corpus.where(F.col("page_content").isNotNull()).select("page_id", "page_content")


def page_count(corpus: DataFrame) -> DataFrame:
    """One row ``n_pages DOUBLE``: pages with content (stubs never count)."""
    return corpus.agg(F.count(F.col("page_content")).cast("double").alias("n_pages"))


def term_occurrences(corpus: DataFrame, stopwords=None, scope_col: str | None = None) -> DataFrame:
    """One row per kept term occurrence ``(page_id[, scope], term)``."""
    keys = ["page_id"] + ([scope_col] if scope_col else [])
    src = corpus.where(F.col("page_content").isNotNull())
    return (src.select(*keys, F.explode(index_terms("page_content")).alias("term"))
            .where(keep_index_term("term", stopwords)))


def page_term_counts(occurrences: DataFrame, scope_col: str | None = None) -> DataFrame:
    """``(term, page_id[, scope], occurrences)``; distinct (term, page) pairs."""
    keys = ([scope_col] if scope_col else []) + ["term", "page_id"]
    return occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))


def term_statistics(page_terms: DataFrame, scope_col: str | None = None) -> DataFrame:
    """Per term (and scope): ``occurrences`` (all kept occurrences) and
    ``pages`` (distinct pages)."""
    keys = ([scope_col] if scope_col else []) + ["term"]
    return page_terms.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"),
                                         F.count(F.lit(1)).alias("pages"))


def build_index(corpus: DataFrame, stopwords=None, scope_col: str | None = None):
    """Return ``(terms, postings)``.

    terms:    ``(term, total_pages)``
    postings: ``(term, page_id)`` distinct

    The rare-term rule counts occurrences over the whole corpus by default;
    with ``scope_col`` it counts inside each scope value (e.g. caller-defined
    chunks of pages), so a term may pass in one scope and fail in another.
    """
    # (term, page) counts feed both the statistics and the postings; written
    # once so the text is scanned and tokenized once, not once per branch
    pt = materialize(page_term_counts(term_occurrences(corpus, stopwords, scope_col), scope_col),
                     "page-terms")
    return index_from_counts(pt, scope_col)


def build_index_with_stopwords(corpus: DataFrame):
    """``(terms, postings)`` of :func:`build_index`, and the stopwords that occur, ``(term)``, from one reading of the text."""
    from spindex.sources.stopwords import stopword_set
    stop = F.col("term").isin(sorted(stopword_set()))
    tokens = scan_indexable(corpus).select("page_id", F.explode(index_terms("page_content")).alias("term"))
    pt = materialize(page_term_counts(tokens.where(keep_index_term("term") | stop)), "page-terms")
    terms, postings = index_from_counts(pt.where(~stop))
    return terms, postings, pt.where(stop).select("term").distinct()


def index_from_counts(pt: DataFrame, scope_col: str | None = None):
    """``(terms, postings)`` from stored ``page_term_counts``: the rare-term rule applies to whole scopes."""
    stats = term_statistics(pt, scope_col)
    keys = ([scope_col] if scope_col else []) + ["term"]
    kept = stats.where(keep_rare_term("term", "occurrences")).select(*keys)
    postings = (pt.join(kept, keys, "left_semi")
                .select("term", "page_id"))
    if scope_col:
        terms = (postings.groupBy("term")
                 .agg(F.count(F.lit(1)).alias("total_pages")))
    else:
        terms = (stats.where(keep_rare_term("term", "occurrences"))
                 .select("term", F.col("pages").alias("total_pages")))
    return terms, postings


def query_scoped_index(corpus: DataFrame, vocabulary: DataFrame, stopwords=None):
    """``(terms, postings)`` restricted to ``vocabulary(term)``.

    Whether a term is kept, and its document frequency, depend only on that
    term's own occurrences, so restricting occurrences to the vocabulary
    before aggregating gives the same rows as the full index for those
    terms.  A query batch then aggregates its own terms only, never the
    corpus vocabulary.  The vocabulary is the build side of the semi join
    (broadcast when AQE measures it small).
    """
    vocab = vocabulary.select("term").distinct()
    occ = term_occurrences(corpus, stopwords).join(vocab, "term", "left_semi")
    pt = materialize(page_term_counts(occ), "page-terms")
    stats = term_statistics(pt)
    kept = stats.where(keep_rare_term("term", "occurrences"))
    terms = kept.select("term", F.col("pages").alias("total_pages"))
    postings = (pt.join(kept.select("term"), "term", "left_semi")
                .select("term", "page_id"))
    return terms, postings


def refresh_document_frequency(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``total_pages`` = number of postings of the term, 0 when it has none
    (the correlated count, written as grouped count + left join)."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return (terms.select("term").join(counts, "term", "left")
            .select("term", F.coalesce("n", F.lit(0)).cast("bigint").alias("total_pages")))


def insert_terms(terms: DataFrame, new_terms: DataFrame) -> DataFrame:
    """Add unseen terms with ``total_pages = 0``; existing terms are kept."""
    fresh = (missing_from(new_terms.select("term").distinct(), terms, ["term"])
             .select("term", F.lit(0).cast("bigint").alias("total_pages")))
    return terms.unionByName(fresh)


def insert_postings(postings: DataFrame, new_postings: DataFrame) -> DataFrame:
    """Add-only postings: conflicts on (term, page_id) are ignored."""
    fresh = missing_from(new_postings.select("term", "page_id").distinct(), postings, ["term", "page_id"])
    return postings.unionByName(fresh)


def posting_lists(terms: DataFrame, postings: DataFrame, block: int = POSTING_BLOCK) -> DataFrame:
    """Posting lists in blocks: ``(term, block, n_pages, page_ids)``.

    A term's pages are dealt by a mix of their ids over ``ceil(df / block)``
    blocks, so a term has as many blocks as its document frequency asks for,
    whether ids are dense or hashes, and no list grows with the corpus (a term
    found on every page becomes many blocks, not one giant row).  ``page_ids``
    is sorted, comma-joined.
    """
    n = terms.select("term", F.expr(f"(total_pages + {block - 1}) DIV {block}").alias("_n")).where("_n > 0")
    # one step of a multiplicative generator, so that ids with a common factor spread as well
    mixed = F.expr("pmod(pmod(page_id, 2147483647L) * 48271L, 2147483647L)")
    return (postings.select("term", "page_id").join(n, "term")
            .groupBy("term", F.pmod(mixed, F.col("_n")).alias("block"))
            .agg(F.count(F.lit(1)).alias("n_pages"),
                 F.array_sort(F.collect_list("page_id")).alias("_ids"))
            .select("term", "block", "n_pages",
                    F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("page_ids")))


def term_row(terms: DataFrame, term: str) -> DataFrame:
    """Equality lookup of one term; on a stored dictionary the predicate is
    pushed to the Parquet scan (row-group statistics skip the rest)."""
    return terms.where(F.col("term") == F.lit(term))


def term_lookup(terms: DataFrame, words: DataFrame) -> DataFrame:
    """IN-list lookup of ``words(term)`` against the dictionary (semi join)."""
    return terms.join(words.select("term").distinct(), "term", "left_semi")


def term_pages(terms: DataFrame, postings: DataFrame, corpus: DataFrame, words: DataFrame) -> DataFrame:
    """Pages of each requested term: terms ⋈ postings ⋈ pages; unknown terms
    give no rows."""
    t = term_lookup(terms, words).select("term")
    return (t.join(postings.select("term", "page_id"), "term")
            .join(corpus.select("page_id", "page_url"), "page_id")
            .select("term", "page_id", "page_url"))
