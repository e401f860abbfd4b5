"""DuckDB twins of the contract queries that SQL can express."""

from __future__ import annotations


def _either_case(word: str) -> str:
    """ASCII letters of a pattern in either case (an ``i`` flag would fold others to them as well)."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = f"({'|'.join(map(_either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))}){_SIGN}([A-Za-z0-9+/_.=-]+)"
_ACCOUNT = "|".join(_either_case(x) for x in ("username", "user", "login", "account", "client_?id"))
# (name, pattern, what a match must be), in the order of the kinds
_SECRETS = (
    ("assign", _ASSIGN, f"length(regexp_extract(hit, {_quoted(_ASSIGN)}, 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(hit) >= 20"),
    ("hex", "[0-9a-f]+", "length(hit) >= 24"),
    ("user", f"(?:{_ACCOUNT}){_SIGN}[A-Za-z0-9+/_.@-]{{3,}}", "true"),
    ("key", "[A-Za-z0-9+/_-]+", "length(hit) >= 24 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') "
                                "AND regexp_matches(hit, '[a-z]')"),
    ("endpoint", r"""[A-Za-z0-9+.-]+://[^ \t\n\x0B\f\r"'<>]+""", "regexp_matches(hit, '^[A-Za-z]')"),
)


def _secrets() -> str:
    """Spans from the lengths of matches and of the pieces between them; weak parts linked within 200 code points."""
    hits = " UNION ALL ".join(f"SELECT row, {k} AS kind, regexp_extract_all(t, {_quoted(p)}) AS h, string_split_regex(t, {_quoted(p)}) AS s FROM d"
                              for k, (_, p, _) in enumerate(_SECRETS))
    fits = " ".join(f"WHEN {k} THEN {c}" for k, (_, _, c) in enumerate(_SECRETS))
    names = "[" + ", ".join(_quoted(n) for n, _, _ in _SECRETS) + "]"

    def apart(kind: int, *others: str) -> str:
        taken = " UNION ALL ".join(f"SELECT * FROM {x}" for x in others)
        return (f"SELECT * FROM found f WHERE kind = {kind} AND NOT EXISTS "
                f"(SELECT 1 FROM ({taken}) o WHERE o.row = f.row AND o.a < f.b AND f.a < o.b)")

    spans = f"string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind, b)"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
one AS (SELECT row, kind, unnest(h) AS hit, unnest(s[1:len(h)]) AS piece, generate_subscripts(h, 1) AS i FROM hits WHERE len(h) > 0),
placed AS (SELECT row, kind, hit, CAST(sum(length(piece) + length(hit)) OVER (PARTITION BY row, kind ORDER BY i) AS BIGINT) AS b FROM one),
found AS MATERIALIZED (SELECT row, kind, b - length(hit) AS a, b FROM placed WHERE CASE kind {fits} END),
base AS (SELECT * FROM found WHERE kind < 3),
users AS MATERIALIZED ({apart(3, 'base')}),
keys AS MATERIALIZED ({apart(4, 'base', 'users')}),
endpoints AS MATERIALIZED ({apart(5, 'base', 'users', 'keys')}),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM users UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM endpoints),
met AS (SELECT w.*, o.kind AS other FROM parts w JOIN parts o ON w.row = o.row
        AND greatest(w.a, o.a) - least(w.b, o.b) <= 200 AND NOT (w.a = o.a AND w.kind = o.kind) WHERE w.kind >= 3),
linked AS (SELECT row, kind, a, b FROM met GROUP BY ALL HAVING CASE kind WHEN 4 THEN bool_or(other IN (1, 3, 5)) WHEN 3 THEN bool_or(other IN (0, 2, 4))
           ELSE bool_or(other IN (1, 3)) AND bool_or(other IN (0, 2, 4)) END),
strong AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1,
                  count(*) FILTER (WHERE kind = 2) AS n2, {spans} AS s FROM base GROUP BY row),
every AS (SELECT row, {spans} AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY row)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(strong.s, '')) AS base_sha256, coalesce(every.s, '') AS spans
FROM d LEFT JOIN strong USING (row) LEFT JOIN every USING (row)"""


def _vector_codes() -> str:
    """Six rounds and a last assignment, each a join of all parts with all entries."""
    apart = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(7):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rn, part, min({{'d': d, 'e': e}}) AS m FROM
  (SELECT p.rn, p.part, c.e, CAST({apart} AS BIGINT) AS d FROM p JOIN c{r} c USING (part)) GROUP BY rn, part)""")
        if r < 6:  # floor division, also of negative sums
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN
  (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM
    (SELECT part, m.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN p USING (rn, part), range(1, 9) t(i) GROUP BY ALL)
   GROUP BY part, e) n USING (part, e))""")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn,
  list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, v[part * 8 + 1 : part * 8 + 8] AS x FROM kept, range(8) t(part)),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS e, x FROM p WHERE rn <= 16),
{", ".join(steps)},
done AS (SELECT rn, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a6 GROUP BY rn),
books AS (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda y: CAST(y AS VARCHAR)), 'string_agg', ','), ',' ORDER BY part, e)) AS s FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256
FROM kept JOIN done USING (rn), books"""


def _divergence() -> str:
    """Dense: every group of a language with every kept term."""
    def p(count, total):
        return f"CAST(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * v) AS BIGINT)"

    gap = "((g.p - {0}) * (g.p - {0})) // (g.p + {0})"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS MATERIALIZED (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, term, coalesce(x.c, 0) AS c, {p("coalesce(x.c, 0)", "g.n")} AS p, {p("k.c", "l.n")} AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT g.lang, g.source, h.source AS item, sum({gap.format("h.p")}) AS f FROM g JOIN g h ON g.lang = h.lang AND g.term = h.term AND g.source <> h.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, {gap.format("g.q")} AS value FROM g WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


def _sharding() -> str:
    """CRC-32 by its table of 256 values, made from the polynomial."""
    return """WITH RECURSIVE bits AS (SELECT CAST(b AS UBIGINT) AS b, CAST(b AS UBIGINT) AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, xor(c >> 1, (c & 1) * 3988292384::UBIGINT), k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, md5('13:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
  CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
    lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM documents, crc),
r AS (SELECT *, CAST((2 * (row_number() OVER (PARTITION BY source ORDER BY key, text_crc32, size) - 1) + 1)::HUGEINT * 1000000000000000000
  // (2 * count(*) OVER (PARTITION BY source)) AS BIGINT) AS fraction FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, key, text_crc32, size) - 1 AS position, count(*) OVER () AS n FROM r),
s AS (SELECT *, position * 8 // n AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY position) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""


_SQL: dict[str, str] = {
    "op8_secrets": _secrets(),
    # a byte-level token per byte of UTF-8
    "op9_token_counts": "SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_tokens FROM documents",
    "op11_vector_codes": _vector_codes(),
    "op12_source_divergence": _divergence(),
    "op13_sharding": _sharding(),
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
