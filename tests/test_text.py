"""Tokenizers and index filters on edge cases."""

import pytest

from spindex.functions.text import index_terms, keep_index_term, keep_rare_term, query_terms

# text -> (index tokens, query tokens)
TOKENS = {
    "naïve": (["nave"], ["na", "ve"]), "a—b": (["ab"], ["a", "b"]), "don't": (["don", "t"], ["don", "t"]),
    "x_y-z": (["x_y-z"], ["x_y-z"]), "#tag": (["#tag"], ["#tag"]), "@me": (["@me"], ["@me"]),
    "A/B": (["a", "b"], ["a", "b"]), "a|b": (["a", "b"], ["a", "b"]), "": ([], []), "?!.,;:": ([], []),
    "Hello, World! The CAT's hat (x+y)": (["hello", "world", "the", "cat", "s", "hat", "x", "y"],) * 2,
    "İstanbul Kelvin": (["stanbul", "kelvin"], ["i", "stanbul", "kelvin"]),
    "tab\tand\nnewline": (["tab", "and", "newline"],) * 2,
}


def test_tokenizers(spark):
    df = spark.createDataFrame([(s,) for s in TOKENS], "s STRING")
    rows = df.select("s", index_terms("s").alias("a"), query_terms("s").alias("b")).collect()
    assert {r["s"]: (list(r["a"]), list(r["b"])) for r in rows} == TOKENS


def test_tokenizers_differ_on_non_ascii(spark):
    df = spark.createDataFrame([("naïve a—b",)], "s STRING")
    r = df.select(index_terms("s").alias("a"), query_terms("s").alias("b")).first()
    assert list(r["a"]) == ["nave", "ab"]
    assert list(r["b"]) == ["na", "ve", "a", "b"]


def _vowels(n, v):
    return ("a" * v + "b" * (n - v))


@pytest.mark.parametrize("term,keep", [
    ("a", False), ("ab", True), ("abc", True), ("abcd", True), ("a" * 14, True), ("b" * 15, True), ("c" * 29, True),
    ("d" * 30, False), (_vowels(21, 7), True), (_vowels(21, 8), False), (_vowels(21, 9), True), ("the", False), ("s", False)])
def test_occurrence_filter(spark, term, keep):
    assert spark.createDataFrame([(term,)], "term STRING").select(keep_index_term("term")).first()[0] == keep


@pytest.mark.parametrize("term,occ,keep", [("ab", 20, False), ("ab", 21, True), ("abcd", 1, True),
                                           ("abc", 1, False), ("a" * 14, 1, True), ("a" * 15, 1, False),
                                           ("a" * 15, 21, True)])
def test_rare_rule(spark, term, occ, keep):
    df = spark.createDataFrame([(term, occ)], "term STRING, n BIGINT")
    assert df.select(keep_rare_term("term", "n")).first()[0] == keep


def test_index_with_stopwords_reads_the_text_once(spark):
    from spindex.operators import index as ix
    rows = [(1, "u/1", "The cats, the cats—and a dog! naïve"), (2, "u/2", "cats & the x"), (3, "u/3", None), (4, "u/4", "")]
    c = spark.createDataFrame(rows, "page_id BIGINT, page_url STRING, page_content STRING")
    terms, postings, stop = ix.build_index_with_stopwords(c)
    t, p = ix.build_index(c)
    assert sorted(map(tuple, terms.collect())) == sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, p.collect()))
    assert sorted(r["term"] for r in stop.collect()) == ["a", "the", "x"]
