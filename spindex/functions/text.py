"""Tokenizers and text normalisation as native Column expressions.

Two tokenizers exist on purpose and differ observably:

* ``index_terms`` (indexing side): drop every non-ASCII character (without a
  separator), turn the punctuation set into spaces, extract term runs, lower
  each term.
* ``query_terms`` (query side, also used to re-read page text at ranking
  time): turn punctuation into spaces, lower the whole text, extract term
  runs.  Non-ASCII characters stay and split terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindex.functions.constants import (
    LONG_TERM_LEN, LONG_TERM_MAX_VOWELS, MAX_TERM_LEN, MIN_TERM_LEN,
    PUNCTUATION, PUNCTUATION_SPACES, RARE_MAX_LEN, RARE_MIN_LEN,
    RARE_MIN_OCCURRENCES, TERM_PATTERN, VOWELS,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_non_ascii(col) -> Column:
    return F.regexp_replace(_c(col), r"[^\x00-\x7F]", "")


def punctuation_to_space(col) -> Column:
    return F.translate(_c(col), PUNCTUATION, PUNCTUATION_SPACES)


def index_terms(col) -> Column:
    """ARRAY<STRING> of index-side terms, in text order, with repeats.

    Only ASCII is left when terms are extracted, so lower-casing the text
    first yields the same terms as lower-casing each term, without a
    per-element lambda.  No punctuation is part of a term, so it separates
    terms as the spaces would that stand for it."""
    return F.regexp_extract_all(F.lower(strip_non_ascii(col)), F.lit(TERM_PATTERN), 0)


def query_terms(col) -> Column:
    """ARRAY<STRING> of query-side terms, in text order, with repeats."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TERM_PATTERN), 0)


def vowel_count(col) -> Column:
    return F.length(F.regexp_replace(_c(col), f"[^{VOWELS}]", ""))


def keep_index_term(term, stopwords=None) -> Column:
    """Per-occurrence filter: stopwords, length 2..29, long-token vowel rule.

    ``stopwords`` is a bounded Python collection (the fixed list by default);
    the membership test compiles to a JVM hash-set lookup.
    """
    from spindex.sources.stopwords import stopword_set
    t = _c(term)
    n = F.length(t)
    v = vowel_count(t)
    words = sorted(stopword_set() if stopwords is None else set(stopwords))
    not_stop = ~t.isin(words) if words else F.lit(True)
    vowel_junk = (n > LONG_TERM_LEN) & (v > LONG_TERM_MAX_VOWELS) & ((v + 1) < F.floor(n / 2))
    return not_stop & (n >= MIN_TERM_LEN) & (n <= MAX_TERM_LEN) & ~vowel_junk


def keep_rare_term(term, occurrences) -> Column:
    """Rare-term rule: keep 3 < length < 15, or more than 20 occurrences."""
    n = F.length(_c(term))
    return ((n > RARE_MIN_LEN) & (n < RARE_MAX_LEN)) | (_c(occurrences) > RARE_MIN_OCCURRENCES)
