"""Secret scans with multipart credential linking, in DataFrame expressions only.

Method.  A credential has parts: an identifier, a secret, an endpoint.  Strong
parts are reported wherever they stand: ``assign`` (a named secret with a
value), ``access`` (an access key id), ``hex`` (a long hexadecimal run).  Weak
candidates say little alone: ``user`` (a named account), ``key`` (a long mixed
run that looks random), ``endpoint`` (a URL).  Parts of one text whose gap is at
most ``SCOPE`` code points are in one scope; they meet by an interval join on
position bins, so the work of a long text is spread and bounded by what a bin
can hold.  A weak candidate is reported when complementary parts are in its
scope: a key with an identifier or an endpoint, a user with a secret, an
endpoint with both an identifier and a secret.

Spans come from splitting the text at the matches: the code points before match
i are those of pieces 0..i and matches 0..i-1.

Defined cases: null text is empty; repeated rows each get their spans (rows are
numbered, ids are not trusted); weak candidates that overlap a strong part, or
an earlier kind of weak candidate, are dropped; texts with very many parts are
compared bin by bin, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindex.session import materialize

STRONG = ("assign", "access", "hex")
WEAK = ("user", "key", "endpoint")
KINDS = STRONG + WEAK
PART = ("__row", "start", "kind", "end")
SCOPE = 200

# Group 1 of assign is the name, group 2 the value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"        # 20 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"  # whole runs only: the same matches, without retries inside a run
USER = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}+"
ENDPOINT = r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]+"""
MIN_VALUE = 6


def _sql(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _spans(hits: str, pieces: str, kind: int) -> str:
    """SQL: array of ``(start, kind, end)`` of the matches."""
    return f"""aggregate(sequence(1, size({hits})),
      CAST(struct(0 AS at, array() AS out) AS struct<at:int, out:array<struct<start:int, kind:int, end:int>>>),
      (acc, i) -> struct(
        acc.at + length({pieces}[i - 1]) + length({hits}[i - 1]) AS at,
        array_append(acc.out, struct(acc.at + length({pieces}[i - 1]) AS start, {kind} AS kind,
                     acc.at + length({pieces}[i - 1]) + length({hits}[i - 1]) AS end)) AS out),
      acc -> acc.out)"""


def _find(df: DataFrame, out: str, pattern: str, kind: int, keep: str | None = None, gate: str | None = None) -> DataFrame:
    """Add the span array ``out``; ``keep``: condition on a match ``h``; ``gate``: what a text must hold."""
    none = "CAST(array() AS array<string>)"
    hits = f"regexp_extract_all(__text, {_sql(pattern)}, 0)"
    df = df.withColumn("__hits", F.expr(f"IF({gate}, {hits}, {none})" if gate else hits))
    df = df.withColumn("__pieces", F.expr(f"IF(size(__hits) > 0, split(__text, {_sql(pattern)}, -1), {none})"))
    spans = _spans("__hits", "__pieces", kind)
    if keep:
        spans = f"filter({spans}, (s, i) -> exists(array(__hits[i]), h -> {keep}))"
    empty = "CAST(array() AS array<struct<start:int, kind:int, end:int>>)"
    return df.withColumn(out, F.expr(f"IF(size(__hits) > 0, {spans}, {empty})")).drop("__hits", "__pieces")


def _cells(parts: DataFrame, size: int, reach: int = 0) -> DataFrame:
    """``parts`` once per bin of ``size`` code points that they cover, or come within ``reach`` of."""
    return parts.withColumn("bin", F.expr(f"explode(sequence(CAST(floor((start - {reach}) / {size}) AS INT), CAST(floor((end - 1 + {reach}) / {size}) AS INT)))"))


def _without_overlaps(weak: DataFrame, others: DataFrame, size: int) -> DataFrame:
    """Parts of ``weak`` that overlap none of ``others``: only parts that share a bin of a text are compared."""
    met = _cells(weak, size).alias("w").join(_cells(others, size).alias("o"), F.expr(
        "w.`__row` = o.`__row` AND w.bin = o.bin AND o.start < w.end AND w.start < o.end"), "left_semi")
    return weak.join(met.select("__row", "start", "kind").distinct(), ["__row", "start", "kind"], "left_anti").select(*PART)


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """The columns ``keep`` (else all) with ``base`` (strong parts) and ``spans`` (those and the linked
    weak ones): arrays of ``(start, kind, end)``, sorted; ``kind`` numbers ``KINDS``."""
    keep = docs.columns if keep is None else keep
    df = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    lower = "lower(__text)"
    value = f"length(regexp_extract(h, {_sql(ASSIGN)}, 2)) >= {MIN_VALUE}"
    df = _find(df, "__assign", ASSIGN, 0, keep=value)
    df = _find(df, "__access", ACCESS, 1, gate="contains(__text, 'AKIA')")
    df = _find(df, "__hex", HEX, 2)
    df = _find(df, "__user", USER, 3, gate=f"({lower} RLIKE r'user|login|account|client')")
    df = _find(df, "__endpoint", ENDPOINT, 5, gate="contains(__text, '://')")
    # a key is reported beside an identifier or an endpoint only: elsewhere it need not be looked for
    df = _find(df, "__key", KEY, 4, gate="(size(__access) + size(__user) + size(__endpoint) > 0)")
    df = df.withColumn("__base", F.sort_array(F.concat("__assign", "__access", "__hex")))
    read = df.select(*keep, "__base", "__user", "__key", "__endpoint").withColumn("__row", F.monotonically_increasing_id())
    read = materialize(read, "secret-parts")

    some = read.where("size(__user) + size(__key) + size(__endpoint) > 0")
    base, user, key, endpoint = (some.select("__row", F.explode(c).alias("p")).select("__row", "p.start", "p.kind", "p.end")
                                 for c in ("__base", "__user", "__key", "__endpoint"))
    taken = materialize(base.unionByName(_without_overlaps(user, base, scope)), "secret-taken")
    taken = materialize(taken.unionByName(_without_overlaps(key, taken, scope)), "secret-taken")
    parts = materialize(taken.unionByName(_without_overlaps(endpoint, taken, scope)), "secret-taken")
    # a weak part is in the bins it covers, the others also in those within reach
    met = _cells(parts.where("kind >= 3"), scope).alias("w").join(
        _cells(parts, scope, scope).alias("o"),
        F.expr(f"w.`__row` = o.`__row` AND w.bin = o.bin AND NOT (w.start = o.start AND w.kind = o.kind) "
               f"AND greatest(w.start, o.start) - least(w.end, o.end) <= {scope}"))
    linked = met.groupBy("w.__row", "w.start", "w.kind", "w.end").agg(
        F.expr("bool_or(o.kind IN (1, 3))").alias("identifier"), F.expr("bool_or(o.kind IN (0, 2, 4))").alias("secret"),
        F.expr("bool_or(o.kind = 5)").alias("endpoint"))
    linked = linked.where("(kind = 4 AND (identifier OR endpoint)) OR (kind = 3 AND secret) OR (kind = 5 AND identifier AND secret)")
    linked = linked.groupBy("__row").agg(F.expr("collect_list(struct(start, kind, end))").alias("__linked"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.sort_array(F.concat("__base", F.coalesce("__linked", empty)))
    return read.join(linked, "__row", "left").select(*keep, F.col("__base").alias("base"), spans.alias("spans"))


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
