"""URL filtering: host words by unigram Viterbi, then multinomial naive Bayes.

Method.  Rules decide first: a rule holds for its host and all subdomains if
the path starts with the rule's; the longest wins.  URLs without a rule are
judged by naive Bayes, trained on the rule-decided ones: its tokens are the
words of the host and of the path.  Host names are segmented: each part of a
host between dots and hyphens is split into the likeliest sequence of words
under a unigram model of the words of all pages.

Spark looks the substrings of the distinct host parts up in the word counts by
a join (no vocabulary is broadcast); Viterbi then sees one host part with the
few words found in it.  The token counts of naive Bayes are summed in
``2 ** BITS`` hash buckets, so the model that tasks get has a fixed size.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and no rule, and is judged on the class shares alone; without training URLs all
others are allowed; ties are allowed; repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindex.session import materialize

BITS = 16
MAX_WORD = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (null, null: none)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``(word, n)`` over the visible words of all pages."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html_col), F.lit(""))), "<[^>]*+>", " ")
    words = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segment(part: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a host part; an unknown stretch of n letters has probability 1 / (total * 10**n)."""
    best = [0.0] + [math.inf] * len(part)
    back = [0] * (len(part) + 1)
    for j in range(1, len(part) + 1):
        for i in range(max(0, j - MAX_WORD), j):
            n = counts.get(part[i:j], 0)
            cost = best[i] + (math.log(total / n) if n else math.log(total) + (j - i) * math.log(10))
            if cost < best[j]:
                best[j], back[j] = cost, i
    words, j = [], len(part)
    while j:
        words.append(part[back[j]:j])
        j = back[j]
    return words[::-1]


def segmented_parts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``(part, words)`` of the distinct parts of ``hosts (host)``; a part of no letters stays whole."""
    parts = hosts.select(F.explode(F.split("host", "[.-]")).alias("part")).where("part <> ''").distinct()
    longest = F.lit(MAX_WORD)
    spots = parts.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("part"))))
    spots = spots.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(longest, F.length("part") - F.col("i") + 1))))
    pieces = spots.select("part", F.expr("substring(part, i, n)").alias("word")).distinct()
    known = pieces.join(words, "word").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total")).first()["total"]

    @F.arrow_udf("array<string>")
    def split_up(parts: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([segment(p, dict(k or ()), total) for p, k in zip(parts.to_pylist(), known.to_pylist())],
                        pa.list_(pa.string()))

    return parts.join(known, "part", "left").select("part", split_up(F.col("part"), F.col("known")).alias("words"))


def judge(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, rules=RULES) -> DataFrame:
    """The columns ``keep`` (else all) with ``host, path, rule, verdict`` and ``log_odds`` of blocking."""
    spark = pages.sparkSession
    keep = pages.columns if keep is None else keep
    host, path = host_path(F.col(url_col))
    urls = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", name).withColumn("verdict", verdict)
    words = materialize(word_counts(pages, html_col), "url-words")
    hosts = urls.select("host").distinct()
    named = hosts.select("host", F.posexplode(F.split("host", "[.-]")).alias("pos", "part")) \
        .join(segmented_parts(hosts, words), "part").groupBy("host") \
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "words"))), lambda s: s["words"])).alias("__words"))
    in_path = F.filter(F.split(F.translate("path", UPPER, LOWER), "[^a-z]+"), lambda w: w != "")
    slots = F.transform(F.concat(F.transform(F.coalesce("__words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("host:"), w)),
                                 F.transform(in_path, lambda w: F.concat(F.lit("path:"), w))),
                        lambda t: F.pmod(F.xxhash64(t), F.lit(1 << BITS)).cast("int"))
    urls = materialize(urls.join(named, "host", "left").withColumn("__slots", slots).drop("__words"), "url-tokens")

    seen = urls.where("verdict IS NOT NULL")
    block = F.sum((F.col("verdict") == "block").cast("bigint"))
    shares = seen.agg(F.count("*").alias("n"), F.coalesce(block, F.lit(0)).alias("b")).first()
    rows = seen.select(F.explode("__slots").alias("slot"), "verdict").groupBy("slot").agg(F.count("*").alias("n"), block.alias("b")).collect()
    blocked, allowed = np.zeros(1 << BITS), np.zeros(1 << BITS)  # at most 2**BITS rows were collected
    for r in rows:
        blocked[r["slot"]], allowed[r["slot"]] = r["b"], r["n"] - r["b"]
    used = max(1, len(rows))
    weights = np.log((blocked + 1) / (blocked.sum() + used)) - np.log((allowed + 1) / (allowed.sum() + used))
    weights[(blocked + allowed) == 0] = 0.0  # a token never seen says nothing
    prior = math.log((shares["b"] + 0.5) / (shares["n"] - shares["b"] + 0.5)) if shares["n"] else -1.0
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def odds(slots: pa.Array) -> pa.Array:
        return pa.array([prior + float(shared.value[s].sum()) if s else prior for s in slots.to_pylist()], pa.float64())

    out = urls.withColumn("log_odds", odds(F.col("__slots")))
    by_method = F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule",
                      F.coalesce("verdict", by_method).alias("verdict"), "log_odds")
