"""DuckDB twins of the registered queries.

Each SQL runs on the driver's pre-registered views (``pages``,
``documents``, ``benchmark``, ...) and returns the same columns as the Spark
query of the same name.  The SQL is written independently from the Spark
plans, from the documented semantics, as the correctness oracle.
"""

from __future__ import annotations


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- Fixed values, stated here once more so that the twins share nothing with the code they check
P = _s(".?!,:;—()[]{}\\'\"/*&~+")
SP = _s(" " * 21)
PAT = _s(r"[A-Za-z0-9_\-#@]+")
STOP = "(" + ", ".join(_s(w) for w in (
    "i me my myself we our ours ourselves your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves whom this that these those am is are was "
    "were be been being have has had having an the and but if or because as until while of at by for with "
    "into through during before after above below to up down in out on off over under again further then "
    "once here there where all both each few more most other some such nor not only own same so than too "
    "very s t can will just don should now a b c d e f g h j k l m n o p q r u v w x y z "
).split()) + ")"
TRACKING = ("utm_source utm_medium utm_campaign utm_term utm_content e ref source ref_source "
            "_hsfp _hssc _hstc gclid fbclid").split()
TWO_LABEL_SUFFIXES = ("co.uk org.uk ac.uk gov.uk com.cn co.jp ne.jp co.kr co.in com.au net.au org.au co.nz com.br com.mx com.ar co.za").split()
NO_TOP_LEVEL = "test example invalid localhost local internal lan home corp".split()


def idx_tokens(src: str) -> str:
    """Index tokenizer: ``(page_id, term)`` per occurrence of ``src``."""
    return (f"SELECT page_id, lower(unnest(regexp_extract_all(translate(regexp_replace("
            f"page_content, '[^\\x00-\\x7F]', '', 'g'), {P}, {SP}), {PAT}))) AS term "
            f"FROM {src} WHERE page_content IS NOT NULL")


def qry(expr: str) -> str:
    """Query tokenizer of a text expression (a list)."""
    return f"regexp_extract_all(lower(translate({expr}, {P}, {SP})), {PAT})"


def _vc(t: str) -> str:
    return f"length(regexp_replace({t}, '[^aeiouy]', '', 'g'))"


KEEP_OCC = (f"term NOT IN {STOP} AND length(term) BETWEEN 2 AND 29 AND NOT "
            f"(length(term) > 20 AND {_vc('term')} > 7 AND {_vc('term')} + 1 < length(term) // 2)")

DOCS = ("docs AS (SELECT doc_id AS page_id, 'doc/' || CAST(doc_id AS VARCHAR) AS page_url, "
        "text AS page_content FROM documents)")

# HTML -> text twin (exact on well-formed pages): drop head/script/style/title
# elements and comments, every tag becomes a space, decode the entities in
# use, collapse whitespace, drop NUL.
PAGE_TEXT = r"""page_txt AS (
  SELECT page_id, url, replace(trim(regexp_replace(
    replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(html,
        '(?s)<head[^>]*>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->',
        ' ', 'g'), '<[^>]*>', ' ', 'g'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'),
    '\s+', ' ', 'g')), chr(0), '') AS text
  FROM pages)"""

PCORPUS = ("pcorpus AS (SELECT page_id, url AS page_url, text AS page_content "
           "FROM page_txt WHERE length(text) > 0)")

TITLE_Q = ("title_q AS (SELECT page_id AS query_id, "
           "regexp_extract(html, '<title>([^<]*)</title>', 1) AS query_text FROM pages)")
BENCH_Q = "bench_q AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"


def index_ctes(corpus: str, p: str = "") -> str:
    """CTEs ``{p}occ, {p}pt, {p}stats, {p}kept, {p}postings, {p}terms`` for
    an index over ``corpus``."""
    return f"""{p}occ AS (SELECT * FROM ({idx_tokens(corpus)}) WHERE {KEEP_OCC}),
{p}pt AS (SELECT term, page_id, count(*) AS occurrences FROM {p}occ GROUP BY term, page_id),
{p}stats AS (SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS pages
             FROM {p}pt GROUP BY term),
{p}kept AS (SELECT term, pages FROM {p}stats
            WHERE (length(term) > 3 AND length(term) < 15) OR occurrences > 20),
{p}postings AS (SELECT pt.term, pt.page_id FROM {p}pt pt JOIN {p}kept USING (term)),
{p}terms AS (SELECT term, pages AS total_pages FROM {p}kept)"""


def weight_ctes(queries: str, corpus: str, terms: str) -> str:
    """CTEs ``qc, nn, wn`` (query term weights)."""
    return f"""qtok AS (SELECT query_id, len(toks) AS q_len, unnest(toks) AS term
          FROM (SELECT query_id, {qry('query_text')} AS toks FROM {queries})),
qc AS (SELECT query_id, term, q_len, count(*) AS q_count FROM qtok GROUP BY ALL),
nn AS (SELECT CAST(count(page_content) AS DOUBLE) AS n_pages FROM {corpus}),
w0 AS (SELECT qc.*, CAST(coalesce(t.total_pages, 0) AS BIGINT) AS df
       FROM qc LEFT JOIN {terms} t USING (term)),
w1 AS (SELECT w0.*, CASE WHEN df > 0 THEN 1 + log10(n_pages / df) ELSE CAST(1 AS DOUBLE) END AS idf
       FROM w0, nn),
w2 AS (SELECT *, q_count / q_len * idf AS q_weight FROM w1),
wn AS (SELECT *, sqrt(sum(q_weight * q_weight) OVER (PARTITION BY query_id)) AS q_norm FROM w2)"""


def score_ctes(corpus: str, postings: str) -> str:
    """CTEs ``cand, tf, final`` (scored candidates)."""
    return f"""cand AS (SELECT DISTINCT wn.query_id, p.page_id FROM wn JOIN {postings} p USING (term)),
tf AS (SELECT page_id, term, doc_len, count(*) AS tf_count
       FROM (SELECT page_id, len(toks) AS doc_len, unnest(toks) AS term
             FROM (SELECT page_id, {qry('page_content')} AS toks FROM {corpus}
                   WHERE page_content IS NOT NULL))
       WHERE term IN (SELECT term FROM wn) GROUP BY ALL),
srows AS (SELECT c.query_id, c.page_id, u.page_url, wn.term, wn.q_count, wn.q_weight, wn.q_norm,
                 coalesce(tf.tf_count / tf.doc_len * wn.idf, CAST(0 AS DOUBLE)) AS d_weight
          FROM cand c JOIN wn USING (query_id)
          LEFT JOIN tf ON tf.page_id = c.page_id AND tf.term = wn.term
          JOIN {corpus} u ON u.page_id = c.page_id),
sagg AS (SELECT query_id, page_id, page_url, sum(q_weight * d_weight) AS dot,
                sqrt(sum(d_weight * d_weight)) AS d_norm, max(q_norm) AS q_norm,
                sum(CASE WHEN contains(lower(page_url), term) THEN q_count * CAST(0.15 AS DOUBLE)
                         ELSE CAST(0 AS DOUBLE) END) AS link_boost
         FROM srows GROUP BY ALL),
ssim AS (SELECT *, CASE WHEN q_norm = 0 OR d_norm = 0 THEN CAST(0 AS DOUBLE)
                        ELSE dot / (q_norm * d_norm) END AS similarity FROM sagg),
final AS (SELECT query_id, page_id, page_url, similarity, link_boost,
                 pow(similarity, 1.2) * (1 + link_boost) AS score FROM ssim)"""


def _top_k(k: int = 20) -> str:
    return f"""SELECT query_id, rank, page_id, page_url, score, similarity, link_boost FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY round(score, 9) DESC, page_url) AS BIGINT) AS rank,
         page_id, page_url, round(score, 9) AS score, round(similarity, 9) AS similarity,
         round(link_boost, 9) AS link_boost FROM final) WHERE rank <= {k}"""


SQL: dict[str, str] = {}

SQL["scan_indexable"] = ("SELECT doc_id AS page_id, CAST(length(text) AS BIGINT) AS content_len "
                         "FROM documents WHERE text IS NOT NULL")

SQL["page_count"] = "SELECT CAST(count(text) AS DOUBLE) AS n_pages FROM documents"

SQL["tokens_index"] = f"""WITH {DOCS}
SELECT page_id, term, count(*) AS occurrences FROM ({idx_tokens('docs')}) GROUP BY ALL"""

SQL["tokens_query"] = f"""SELECT query_id, CAST(i - 1 AS BIGINT) AS pos, term FROM (
  SELECT item_id AS query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i
  FROM (SELECT item_id, {qry('text')} AS toks FROM benchmark))"""

SQL["stopword_counts"] = f"""WITH {DOCS}
SELECT term AS word, count(*) AS occurrences FROM ({idx_tokens('docs')})
WHERE term IN {STOP} GROUP BY term"""

SQL["index_occurrences"] = f"""WITH {DOCS}, {index_ctes('docs')}
SELECT term, occurrences, pages FROM stats"""

SQL["index_terms"] = f"""WITH {DOCS}, {index_ctes('docs')}
SELECT term, total_pages FROM terms"""

SQL["index_postings"] = f"""WITH {DOCS}, {index_ctes('docs')}
SELECT term, page_id FROM postings"""

SQL["index_df"] = f"""WITH {DOCS}, {index_ctes('docs')},
seen_stop AS (SELECT DISTINCT term FROM ({idx_tokens('docs')}) WHERE term IN {STOP}),
dict AS (SELECT term FROM terms UNION SELECT term FROM seen_stop),
cnt AS (SELECT term, count(*) AS n FROM postings GROUP BY term)
SELECT d.term, CAST(coalesce(cnt.n, 0) AS BIGINT) AS total_pages FROM dict d LEFT JOIN cnt USING (term)"""

SQL["posting_lists"] = f"""WITH {DOCS}, {index_ctes('docs')}
SELECT term, ((page_id % 2147483647 + 2147483647) % 2147483647 * 48271) % 2147483647
             % ((total_pages + 1023) // 1024) AS block, count(*) AS n_pages,
       array_to_string(list_sort(list(page_id)), ',') AS page_ids
FROM postings JOIN terms USING (term) GROUP BY ALL"""

SQL["term_lookup"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')}
SELECT term, total_pages FROM terms WHERE term IN (SELECT term FROM qc)"""

SQL["term_row"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')}
SELECT term, total_pages FROM terms WHERE term IN (SELECT term FROM qc) ORDER BY term LIMIT 1"""

SQL["term_pages"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')}
SELECT t.term, p.page_id, d.page_url FROM terms t JOIN postings p USING (term)
JOIN docs d USING (page_id) WHERE t.term IN (SELECT term FROM qc)"""

SQL["term_frequency"] = f"""WITH {DOCS}, {BENCH_Q},
vocab AS (SELECT DISTINCT unnest({qry('query_text')}) AS term FROM bench_q)
SELECT page_id, term, doc_len, count(*) AS tf_count
FROM (SELECT page_id, len(toks) AS doc_len, unnest(toks) AS term
      FROM (SELECT page_id, {qry('page_content')} AS toks FROM docs WHERE page_content IS NOT NULL))
WHERE term IN (SELECT term FROM vocab) GROUP BY ALL"""

SQL["idf_weights"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')}
SELECT query_id, term, df, round(idf, 9) AS idf FROM wn"""

SQL["tfidf_vectors"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')}
SELECT query_id, term, q_count, q_len, round(q_weight, 9) AS q_weight, round(q_norm, 9) AS q_norm FROM wn"""

SQL["cosine_scores"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')},
{score_ctes('docs', 'postings')}
SELECT query_id, page_id, round(similarity, 9) AS similarity, round(score, 9) AS score FROM final"""

SQL["link_boost"] = f"""WITH {PAGE_TEXT}, {PCORPUS}, {index_ctes('pcorpus')}, {TITLE_Q},
{weight_ctes('title_q', 'pcorpus', 'terms')},
{score_ctes('pcorpus', 'postings')}
SELECT query_id, page_id, page_url, round(link_boost, 9) AS link_boost FROM final"""

SQL["search_top20"] = f"""WITH {PAGE_TEXT}, {PCORPUS}, {index_ctes('pcorpus')}, {TITLE_Q},
first_q AS (SELECT * FROM title_q ORDER BY query_id LIMIT 1),
{weight_ctes('first_q', 'pcorpus', 'terms')},
{score_ctes('pcorpus', 'postings')}
SELECT query_id, page_id, page_url, round(score, 9) AS score, round(similarity, 9) AS similarity,
       round(link_boost, 9) AS link_boost
FROM final ORDER BY round(score, 9) DESC, page_url LIMIT 20"""

SQL["search_batch"] = f"""WITH {PAGE_TEXT}, {PCORPUS}, {index_ctes('pcorpus')}, {TITLE_Q},
{weight_ctes('title_q', 'pcorpus', 'terms')},
{score_ctes('pcorpus', 'postings')}
{_top_k(20)}"""

SQL["search_documents"] = f"""WITH {DOCS}, {index_ctes('docs')}, {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')},
{score_ctes('docs', 'postings')}
{_top_k(20)}"""



# --- responses, parsing, outlinks, ingest -------------------------------------------

def text_twin(expr: str) -> str:
    return f"""replace(trim(regexp_replace(
    replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace({expr},
        '(?s)<head[^>]*>.*?</head>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->',
        ' ', 'g'), '<[^>]*>', ' ', 'g'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'),
    '\\s+', ' ', 'g')), chr(0), '')"""


def fixture(src: str) -> str:
    """Response fixture over ``src(page_id, url, html, seq)``."""
    return f"""SELECT page_id, url, seq, html,
  CASE WHEN page_id % 17 = 0 THEN 429 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END AS status,
  page_id % 19 <> 0 AS received,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'TEXT/HTML'
       ELSE 'text/html; charset=utf-8' END AS ct,
  CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'fr' WHEN 2 THEN '' ELSE 'en-US' END AS lang,
  CASE page_id % 11 WHEN 0 THEN '3145728' WHEN 1 THEN '3145729' WHEN 2 THEN 'abc'
       ELSE CAST(length(html) AS VARCHAR) END AS cl,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '120' WHEN 2 THEN 'Wed, 21 Oct 2026 07:28:00 GMT'
       ELSE 'soon' END AS retry_after,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(seq) AS fetched_at
FROM {src}"""


GOOD = ("received AND (cl IS NULL OR coalesce(TRY_CAST(trim(cl) AS BIGINT) <= 3145728, false)) "
        "AND (ct IS NULL OR ct = '' OR contains(ct, 'text/html')) "
        "AND (lang IS NULL OR lang = '' OR contains(lang, 'en'))")

_SUFFIXES = " OR ".join(f"ends_with(link, '{x}')" for x in
                        (".jpg", ".png", ".pdf", ".css", ".js", ".zip", ".exe"))
_MARKERS = " OR ".join(f"contains(link, '{x}')" for x in ("mailto@", "mailto:", "tel:"))


def hrefs(src: str, key: str = "page_id") -> str:
    """``({key}, url, pos, href)`` of every anchor of ``src({key}, url, html)``."""
    return f"""SELECT {key}, url, CAST(i - 1 AS BIGINT) AS pos, href FROM (
  SELECT {key}, url, unnest(h) AS href, generate_subscripts(h, 1) AS i
  FROM (SELECT {key}, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM {src}))"""


def outlinks(src: str, key: str = "page_id") -> str:
    """``({key}, url, pos, outlink)``: kept and resolved anchors."""
    return f"""SELECT {key}, url, pos,
  CASE WHEN contains(cut, 'https://') THEN cut WHEN cut = '' THEN url
       ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || cut END AS outlink
FROM (SELECT *, split_part(link, '#', 1) AS cut FROM (
  SELECT *, regexp_replace(href, '/+$', '') AS link FROM ({hrefs(src, key)})))
WHERE href IS NOT NULL AND href <> '' AND length(link) < 750
  AND NOT ({_SUFFIXES}) AND NOT ({_MARKERS})"""


PTEXT = f"ptext AS (SELECT page_id, url, html, {text_twin('html')} AS text FROM pages)"

SQL["response_filter"] = f"""WITH b AS (SELECT page_id, url, html, page_id AS seq FROM pages),
f AS ({fixture('b')})
SELECT url, status FROM f WHERE {GOOD}"""

SQL["decoded_bodies"] = """SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN chr(65533) WHEN 1 THEN chr(65533)
  WHEN 2 THEN chr(65533) || chr(65533) ELSE '' END || 'é' AS text FROM pages"""

SQL["crawl_counters"] = f"""WITH b AS (SELECT page_id, url, html, page_id AS seq FROM pages),
f AS ({fixture('b')}),
got AS (SELECT page_id, url, html, {text_twin('html')} AS text FROM f WHERE {GOOD}),
texts AS (SELECT page_id, url AS page_url, text AS page_content FROM got WHERE length(text) > 0),
{index_ctes('texts')}
SELECT (SELECT count(*) FROM f WHERE received) AS received, (SELECT count(*) FROM got) AS good,
       (SELECT count(*) FROM texts) AS with_text, (SELECT count(DISTINCT page_id) FROM postings) AS indexed"""

SQL["url_edges"] = """WITH o AS (SELECT page_id, CAST(page_id AS VARCHAR) AS n,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin FROM pages)
SELECT page_id,
  CASE page_id % 5 WHEN 0 THEN '/a?' WHEN 1 THEN '/a;' WHEN 2 THEN '/a;?x=1' WHEN 3 THEN '/a;p=1?b' ELSE '/a//b' END AS href,
  origin || CASE page_id % 5 WHEN 0 THEN '/a' WHEN 1 THEN '/a' WHEN 2 THEN '/a?x=1' WHEN 3 THEN '/a;p=1?b' ELSE '/a//b' END AS outlink,
  CASE page_id % 5 WHEN 0 THEN 'HTTPS://h.com/p' || n WHEN 1 THEN 'https://h.com/' || n || '/a;?b=1'
    WHEN 2 THEN 'https://h.com/' || n || '/a?q=%zz%41' WHEN 3 THEN 'https://h.com/' || n || '/a;x?utm_source=1#f'
    ELSE 'https://h.com/' || n || '/?k=a+b&k=%E9' END AS raw,
  CASE page_id % 5 WHEN 0 THEN 'https://h.com/p' || n WHEN 1 THEN 'https://h.com/' || n || '/a?b=1'
    WHEN 2 THEN 'https://h.com/' || n || '/a?q=%25zzA' WHEN 3 THEN 'https://h.com/' || n || '/a;x#f'
    ELSE 'https://h.com/' || n || '/?k=a+b&k=%EF%BF%BD' END AS canonical_url
FROM o"""

SQL["suffix_domains"] = """WITH o AS (SELECT page_id, page_id % 6 AS k, CAST(page_id AS VARCHAR) AS n FROM pages)
SELECT page_id,
  CASE k WHEN 0 THEN 'https://w.s' || n || '.co.uk:8080/p' WHEN 1 THEN 'http://a.b' || n || '.ck/'
    WHEN 2 THEN 'https://x.www.ck/' || n WHEN 3 THEN 'https://u@m.shop' || n || '.xyz?q'
    WHEN 4 THEN 'https://10.0.0.' || n || '/' ELSE 'https://host' || n || '.unlisted/' END AS url,
  CASE k WHEN 0 THEN 'w.s' || n || '.co.uk' WHEN 1 THEN 'a.b' || n || '.ck' WHEN 2 THEN 'x.www.ck'
    WHEN 3 THEN 'm.shop' || n || '.xyz' WHEN 4 THEN '10.0.0.' || n ELSE 'host' || n || '.unlisted' END AS host,
  CASE k WHEN 0 THEN 's' || n || '.co.uk' WHEN 1 THEN 'a.b' || n || '.ck' WHEN 2 THEN 'www.ck'
    WHEN 3 THEN 'shop' || n || '.xyz' ELSE '' END AS domain
FROM o"""

SQL["retry_dates"] = """SELECT page_id, TIMESTAMP '2026-01-01 00:00:00' + to_seconds((page_id % 1000000) * 977) AS retry_at
FROM pages"""

SQL["retry_hints"] = f"""WITH b AS (SELECT page_id, url, html, page_id AS seq FROM pages),
f AS ({fixture('b')})
SELECT url, status, retry_after, CASE WHEN status NOT IN (403, 429, 503) THEN NULL
  WHEN retry_after IS NULL OR retry_after = 'soon' THEN fetched_at + INTERVAL 15 SECOND
  WHEN retry_after = '120' THEN fetched_at + INTERVAL 120 SECOND ELSE TIMESTAMP '2026-10-21 07:28:00' END AS wait_until
FROM f WHERE received"""

SQL["page_text"] = f"""WITH {PTEXT}
SELECT page_id, url, text FROM ptext WHERE length(text) > 0"""

SQL["outlinks_raw"] = f"""WITH {PTEXT}, nonempty AS (SELECT * FROM ptext WHERE length(text) > 0)
SELECT page_id, pos, href FROM ({hrefs('nonempty')})"""

SQL["outlinks_resolved"] = f"""WITH {PTEXT}, nonempty AS (SELECT * FROM ptext WHERE length(text) > 0)
SELECT page_id, pos, outlink FROM ({outlinks('nonempty')})"""

INGEST = f"""b1src AS (SELECT page_id, url, html, page_id AS seq FROM pages),
b2src AS (
  SELECT page_id, url, replace(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g'), '</article>',
         '<p>Second visit.</p></article>') AS html, page_id + 1000000 AS seq
  FROM pages WHERE contains(url, '?')
  UNION ALL
  SELECT page_id, url, html, page_id + 500000 AS seq FROM pages WHERE contains(url, '?')),
f1 AS ({fixture('b1src')}),
f2 AS ({fixture('b2src')}),
r1 AS (SELECT * FROM (SELECT url, seq, html, {text_twin('html')} AS text FROM f1 WHERE {GOOD})
       WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
r2 AS (SELECT * FROM (SELECT url, seq, html, {text_twin('html')} AS text FROM f2 WHERE {GOOD})
       WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
l1 AS (SELECT DISTINCT url, outlink FROM ({outlinks('r1', 'seq')})),
l2 AS (SELECT DISTINCT url, outlink FROM ({outlinks('r2', 'seq')})),
fetched AS (SELECT url FROM r1 UNION SELECT url FROM r2),
stubs AS (SELECT outlink AS url FROM l1 UNION SELECT outlink FROM l2 EXCEPT SELECT url FROM fetched),
stored AS (
  SELECT f.url AS page_url, coalesce(r2.text, r1.text) AS page_content
  FROM fetched f LEFT JOIN r1 USING (url) LEFT JOIN r2 USING (url)
  UNION ALL SELECT url, NULL FROM stubs),
edges AS (SELECT url AS source_url, outlink AS target_url FROM l1
          UNION SELECT url, outlink FROM l2)"""

SQL["pages_upserted"] = f"""WITH {INGEST}
SELECT page_url, page_content FROM stored WHERE page_content IS NOT NULL"""

SQL["pages_with_stubs"] = f"""WITH {INGEST}
SELECT page_url, page_content IS NOT NULL AS has_content FROM stored"""

SQL["link_edges"] = f"""WITH {INGEST}
SELECT source_url, target_url FROM edges"""

SQL["neighbours_out"] = f"""WITH {INGEST}
SELECT source_url AS page_url, target_url AS neighbour_url FROM edges"""

SQL["neighbours_in"] = f"""WITH {INGEST}
SELECT target_url AS page_url, source_url AS neighbour_url FROM edges"""

SQL["ingest_counts"] = f"""WITH {INGEST},
s1 AS (SELECT DISTINCT outlink FROM l1 WHERE outlink NOT IN (SELECT url FROM r1))
SELECT CAST(1 AS BIGINT) AS batch, (SELECT count(*) FROM r1) AS pages_stored,
       (SELECT count(*) FROM s1) AS stubs_added, (SELECT count(*) FROM l1) AS edges_added
UNION ALL
SELECT CAST(2 AS BIGINT), (SELECT count(*) FROM r2),
       (SELECT count(*) FROM (SELECT DISTINCT outlink FROM l2 WHERE outlink NOT IN (SELECT url FROM r1)
                              AND outlink NOT IN (SELECT outlink FROM s1)
                              AND outlink NOT IN (SELECT url FROM r2))),
       (SELECT count(*) FROM (SELECT url, outlink FROM l2 EXCEPT SELECT url, outlink FROM l1))"""

# --- URLs and domains ------------------------------------------------------------------

_BLOCKED = "(" + ", ".join(_s(x) for x in TRACKING) + ")"

SQL["canonical_urls"] = f"""WITH u AS (
  SELECT page_id, url, split_part(url, '#', 1) AS pre,
         CASE WHEN contains(url, '#') THEN substr(url, strpos(url, '#') + 1) END AS frag FROM pages),
v AS (SELECT *, split_part(pre, '?', 1) AS base,
             CASE WHEN contains(pre, '?') THEN substr(pre, strpos(pre, '?') + 1) ELSE '' END AS q FROM u),
pairs AS (SELECT page_id, unnest(string_split(q, '&')) AS p, generate_subscripts(string_split(q, '&'), 1) AS i
          FROM v),
kept AS (SELECT page_id, string_agg(p, '&' ORDER BY i) AS nq FROM pairs
         WHERE strpos(p, '=') > 0 AND substr(p, strpos(p, '=') + 1) <> ''
           AND lower(split_part(p, '=', 1)) NOT IN {_BLOCKED}
         GROUP BY page_id)
SELECT v.page_id, v.url, v.base || CASE WHEN coalesce(nq, '') <> '' THEN '?' || nq ELSE '' END
       || CASE WHEN coalesce(frag, '') <> '' THEN '#' || frag ELSE '' END AS canonical_url
FROM v LEFT JOIN kept USING (page_id)"""

def host_sql(u: str) -> str:
    rest = f"regexp_replace({u}, '^(?i)(?:[a-z][a-z0-9+.\\-]*:)?//', '')"
    netloc = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    return (f"lower(regexp_replace(regexp_replace(regexp_replace({netloc}, '^.*@', ''), "
            f"':[0-9]*$', ''), '\\.+$', ''))")


def domain_sql(host: str) -> str:
    last = f"split_part({host}, '.', -1)"
    two = f"regexp_extract({host}, '([^.]+\\.[^.]+)$', 1)"
    listed = f"{two} IN ({', '.join(_s(x) for x in TWO_LABEL_SUFFIXES)})"
    top = f"regexp_full_match({last}, '[a-z][a-z]+|xn--[a-z0-9-]+') AND {last} NOT IN ({', '.join(_s(x) for x in NO_TOP_LEVEL)})"
    return (f"CASE WHEN NOT ({top}) OR NOT contains({host}, '.') THEN '' "
            f"WHEN {listed} THEN regexp_extract({host}, '([^.]+\\.[^.]+\\.[^.]+)$', 1) ELSE {two} END")


def host_key_sql(u: str, host: str, domain: str) -> str:
    return (f"(CASE WHEN contains({u}, 'https') THEN 'https://' ELSE 'http://' END || "
            f"CASE WHEN {domain} <> '' THEN {host} ELSE '' END)")


SQL["url_domains"] = f"""WITH h AS (SELECT page_id, url, {host_sql('url')} AS host FROM pages),
d AS (SELECT *, {domain_sql('host')} AS domain FROM h),
k AS (SELECT *, {host_key_sql('url', 'host', 'domain')} AS host_key FROM d)
SELECT page_id, url, host, host_key, domain, host_key NOT IN ('http://', 'https://') AS valid FROM k"""

SQL["domain_sizes"] = f"""WITH h AS (SELECT url, {host_sql('url')} AS host FROM pages),
d AS (SELECT {domain_sql('host')} AS domain, count(DISTINCT url) AS n_urls FROM h GROUP BY 1)
SELECT domain, n_urls, CAST(row_number() OVER (ORDER BY n_urls DESC, domain) AS BIGINT) AS domain_rank
FROM d"""

SQL["seed_urls"] = """SELECT CAST(floor(pos / 3) AS BIGINT) AS batch_id, CAST(pos % 3 AS BIGINT) AS slot, url
FROM (SELECT trim(url) AS url, row_number() OVER (ORDER BY page_id) - 1 AS pos FROM pages
      WHERE trim(url) <> '')"""



# --- politeness ---------------------------------------------------------------------
# Robots fixture, parsed by hand from the five literal files (category =
# length(host) % 5): 0 failed fetch, 1 empty file, 2 first-match rules with
# crawl-delay 2 and request-rate 1/5 (5 s), 3 rules with delay 0, 4 rules of
# the catch-all group while another agent has its own delay.
AS_OF = "TIMESTAMP '2024-01-01 00:03:20'"

HOSTS = f"""hosts AS (
  SELECT DISTINCT {host_key_sql('url', 'host', 'domain')} AS host_key, host, length(host) % 5 AS cat
  FROM (SELECT url, host, {domain_sql('host')} AS domain FROM (SELECT url, {host_sql('url')} AS host FROM pages))
  WHERE domain <> ''),
rob AS (SELECT host_key, cat,
  cat <> 0 AS has_rules,
  CASE cat WHEN 0 THEN NULL WHEN 2 THEN CAST(5.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS rate_limit,
  CASE cat WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'D:/private|A:/private/ok'
           WHEN 3 THEN 'D:/fr/|D:/es|A:/' ELSE 'A:/en/|D:/' END AS rules_text
  FROM hosts)"""


def allowed_sql(cat: str, path: str) -> str:
    return f"""CASE WHEN {cat} IS NULL OR {cat} IN (0, 1) THEN true
     WHEN {cat} = 2 THEN NOT starts_with({path}, '/private')
     WHEN {cat} = 3 THEN NOT (starts_with({path}, '/fr/') OR starts_with({path}, '/es'))
     ELSE starts_with({path}, '/en/') END"""


def req_path(u: str) -> str:
    return (f"coalesce(nullif(replace(replace(replace(replace(regexp_extract({u}, "
            f"'^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*(.*)$', 1), '?', '%3F'), '=', '%3D'), '&', '%26'), "
            f"'#', '%23'), ''), '/')")


B1 = "SELECT page_id, url, html, page_id AS seq FROM pages"
B1_B2 = f"""{B1}
  UNION ALL
  SELECT page_id, url, replace(regexp_replace(html, '(?s)<nav>.*?</nav>', '', 'g'), '</article>',
         '<p>Second visit.</p></article>') AS html, page_id + 1000000 AS seq
  FROM pages WHERE contains(url, '?')
  UNION ALL
  SELECT page_id, url, html, page_id + 500000 AS seq FROM pages WHERE contains(url, '?')"""


def waits_ctes(source: str) -> str:
    """CTEs ``good, waits, sleeps`` for the responses of ``source`` rows."""
    return f"""b AS ({source}),
f AS ({fixture('b')}),
good AS (SELECT * FROM f WHERE {GOOD}),
gk AS (SELECT g.*, {host_key_sql('url', 'host', 'domain')} AS host_key
       FROM (SELECT good.*, {domain_sql('host')} AS domain
             FROM (SELECT good.*, {host_sql('url')} AS host FROM good) good) g),
gw AS (SELECT gk.host_key, gk.fetched_at,
  coalesce(
    CASE WHEN gk.status IN (403, 429, 503) THEN
      CASE WHEN retry_after IS NULL OR retry_after = '' THEN gk.fetched_at + INTERVAL 15 SECOND
           WHEN regexp_full_match(retry_after, '[0-9]+') THEN gk.fetched_at + to_seconds(CAST(retry_after AS BIGINT))
           WHEN retry_after = 'Wed, 21 Oct 2026 07:28:00 GMT' THEN TIMESTAMP '2026-10-21 07:28:00'
           ELSE gk.fetched_at + INTERVAL 15 SECOND END END,
    CASE WHEN rob.cat IS NULL OR rob.cat = 0 THEN NULL
         ELSE gk.fetched_at + to_milliseconds(CAST(floor(greatest(coalesce(rob.rate_limit, 0), 0.2) * 1000) AS BIGINT)) END,
    gk.fetched_at + INTERVAL 1 SECOND) AS t
  FROM gk LEFT JOIN rob USING (host_key)),
waits AS (SELECT host_key, arg_max(t, fetched_at) AS next_allowed_at FROM gw GROUP BY host_key),
sleeps AS (SELECT host_key, CASE WHEN s > 0.05 THEN s ELSE CAST(0 AS DOUBLE) END AS sleep_seconds
           FROM (SELECT host_key, (epoch_us(next_allowed_at) - epoch_us({AS_OF})) / 1000000.0 AS s FROM waits))"""


WAITS = waits_ctes(B1)

PAGE_HOSTS = f"""ph AS (SELECT url, {host_key_sql('url', 'host', 'domain')} AS host_key
       FROM (SELECT url, host, {domain_sql('host')} AS domain FROM (SELECT url, {host_sql('url')} AS host FROM pages)))"""

DEFER = f"""{PAGE_HOSTS},
hc AS (SELECT host_key, count(DISTINCT url) AS n_urls FROM ph GROUP BY host_key),
hd AS (SELECT hc.host_key, n_urls, coalesce(sleeps.sleep_seconds, CAST(0 AS DOUBLE)) AS sleep_seconds
       FROM hc LEFT JOIN sleeps USING (host_key)),
defer AS (SELECT ph.url, hd.*, NOT (hd.sleep_seconds * hd.n_urls < 3) AS deferred
          FROM ph JOIN hd USING (host_key))"""

SQL["stream_waits"] = f"""WITH {HOSTS}, {waits_ctes(B1_B2)}
SELECT host_key, next_allowed_at FROM waits"""

SQL["robots_rules"] = f"""WITH {HOSTS}
SELECT host_key, has_rules, rate_limit, rules_text FROM rob"""

SQL["robots_urls"] = f"""WITH {PAGE_HOSTS}
SELECT DISTINCT host_key, host_key || '/robots.txt' AS robots_url, host_key AS from_robots
FROM ph WHERE host_key NOT IN ('http://', 'https://')"""

SQL["robots_allowed"] = f"""WITH {HOSTS}, {PAGE_HOSTS}
SELECT p.page_id, p.url, ph.host_key, {allowed_sql('rob.cat', req_path('p.url'))} AS allowed
FROM pages p JOIN ph USING (url) LEFT JOIN rob USING (host_key)"""

SQL["next_allowed"] = f"""WITH {HOSTS}, {WAITS}
SELECT host_key, next_allowed_at FROM waits"""

SQL["sleep_times"] = f"""WITH {HOSTS}, {WAITS}
SELECT host_key, round(sleep_seconds, 9) AS sleep_seconds FROM sleeps"""

SQL["deferred_urls"] = f"""WITH {HOSTS}, {WAITS}, {DEFER}
SELECT url, host_key, n_urls, round(sleep_seconds, 9) AS sleep_seconds, deferred FROM defer"""

SQL["batch_wait"] = f"""WITH {HOSTS}, {WAITS}, {DEFER}
SELECT round(max(sleep_seconds), 9) AS wait_seconds FROM (SELECT DISTINCT host_key, sleep_seconds
                                                         FROM defer WHERE NOT deferred)"""

SQL["politeness_metrics"] = f"""WITH {HOSTS}, {PAGE_HOSTS},
seeds AS (SELECT (row_number() OVER (ORDER BY page_id) - 1) // 3 AS batch_id, url FROM pages WHERE trim(url) <> ''),
pairs AS (SELECT DISTINCT s.batch_id, ph.host_key FROM seeds s JOIN ph USING (url)
          WHERE ph.host_key NOT IN ('http://', 'https://')),
hs AS (SELECT DISTINCT p.host_key, rob.cat FROM pairs p LEFT JOIN rob USING (host_key)),
m AS (SELECT count(*) AS misses, count(*) FILTER (WHERE cat IS NULL OR cat = 0) AS blocked FROM hs),
t AS (SELECT count(*) AS lookups FROM pairs)
SELECT lookups - misses AS cache_hits, misses, blocked,
       round((lookups - misses) * 100.0 / nullif(lookups, 0), 9) AS cache_hit_pct,
       round(blocked * 100.0 / nullif(misses, 0), 9) AS blocked_pct
FROM m, t"""

CANDS = f"""{PTEXT}, nonempty AS (SELECT * FROM ptext WHERE length(text) > 0),
links AS ({outlinks('nonempty')}),
cands AS (SELECT DISTINCT outlink AS url FROM links
          EXCEPT SELECT outlink FROM links WHERE contains(url, '/en/'))"""

SQL["unseen_urls"] = f"""WITH {CANDS}
SELECT url FROM cands"""

# batches of 50 are planned over all valid candidates; politeness and robots act inside each batch
def frontier_ctes(domain: str) -> str:
    return f"""{HOSTS}, {WAITS}, {CANDS},
ch AS (SELECT url, host, {domain} AS domain FROM (SELECT url, {host_sql('url')} AS host FROM cands)),
ck AS (SELECT url, host, domain, {host_key_sql('url', 'host', 'domain')} AS host_key FROM ch),
valid AS (SELECT * FROM ck WHERE host_key NOT IN ('http://', 'https://')),
doms AS (SELECT domain, row_number() OVER (ORDER BY count(*) DESC, domain) - 1 AS drank FROM valid GROUP BY domain),
rounds AS (SELECT v.*, d.drank, row_number() OVER (PARTITION BY v.domain ORDER BY v.url) AS round
           FROM valid v JOIN doms d USING (domain)),
placed AS (SELECT *, row_number() OVER (ORDER BY round, drank) - 1 AS p FROM rounds),
planned AS (SELECT *, CAST(p // 50 AS BIGINT) AS batch_id, CAST(p % 50 AS BIGINT) AS pos FROM placed),
load AS (SELECT batch_id, host_key, count(*) AS n_urls FROM planned GROUP BY ALL),
since AS (SELECT host_key, (epoch_us(next_allowed_at) - (SELECT max(epoch_us(fetched_at)) FROM gw)) / 1000000.0 AS s
          FROM waits),
waited AS (SELECT p.*, coalesce(CASE WHEN s > 0.05 THEN s END, 0) * l.n_urls < 3 AS ready
           FROM planned p JOIN load l USING (batch_id, host_key) LEFT JOIN since USING (host_key)),
fate AS (SELECT w.*, CASE WHEN NOT ready THEN 'deferred' WHEN {allowed_sql('rob.cat', req_path('w.url'))} THEN 'fetch'
                     ELSE 'disallowed' END AS outcome
         FROM waited w LEFT JOIN rob USING (host_key))"""


FRONTIER = frontier_ctes(domain_sql("host"))

SQL["frontier_batches"] = f"""WITH {FRONTIER}
SELECT batch_id, pos, url, domain, CAST(round AS BIGINT) AS round FROM fate WHERE outcome = 'fetch'"""

SQL["frontier_outcomes"] = f"""WITH {FRONTIER}
SELECT url, batch_id, outcome FROM fate"""

# domains under the supplied rules: labels below example.com, two below example.net and example.org (one for thther)
RULED_DOMAIN = r"""CASE WHEN regexp_matches(host, '(^|\.)thther\.example\.org$') THEN 'thther.example.org'
  WHEN regexp_matches(host, '\.example\.(net|org)$') THEN regexp_extract(host, '([^.]+\.[^.]+\.example\.(net|org))$', 1)
  WHEN regexp_matches(host, '(^|\.)example\.com$') THEN regexp_extract(host, '([^.]+\.example\.com)$', 1)
  WHEN regexp_matches(host, '\.(com|net|org|co\.th)$') THEN regexp_extract(host, '([^.]+\.(com|net|org|co\.th))$', 1)
  ELSE '' END"""

SQL["frontier_by_rules"] = f"""WITH {frontier_ctes(RULED_DOMAIN)}
SELECT url, batch_id, outcome FROM fate"""

SQL["host_domains"] = f"""WITH {PTEXT}, nonempty AS (SELECT * FROM ptext WHERE length(text) > 0),
u AS (SELECT url FROM pages UNION SELECT outlink FROM ({outlinks('nonempty')})),
h AS (SELECT url, {host_sql('url')} AS host FROM u),
d AS (SELECT url, host, {RULED_DOMAIN} AS domain FROM h)
SELECT url, host, domain, {host_key_sql('url', 'host', 'domain')} AS host_key FROM d"""

SQL["crawl_budget"] = f"""WITH {PTEXT},
ord AS (SELECT page_id, url, text, html, row_number() OVER (ORDER BY page_id, url) AS fetch_rank FROM ptext),
em AS (SELECT * FROM ord WHERE fetch_rank <= 10000 AND length(text) > 0),
links AS ({outlinks('em')}),
n AS (SELECT page_id, count(*) AS n_outlinks FROM links GROUP BY page_id)
SELECT o.url, CAST(o.fetch_rank AS BIGINT) AS fetch_rank, o.fetch_rank <= 10000 AS emits_links,
       CAST(coalesce(n.n_outlinks, 0) AS BIGINT) AS n_outlinks
FROM ord o LEFT JOIN n USING (page_id)"""

SQL["integrity_report"] = f"""WITH {INGEST}, {DOCS}, {index_ctes('docs')},
pcount AS (SELECT term, count(*) AS n FROM postings GROUP BY term)
SELECT 'pages_unique_page_id' AS rule, CAST(count(*) - count(DISTINCT page_id) AS BIGINT) AS violations,
       CAST(count(*) AS BIGINT) AS checked FROM pages
UNION ALL SELECT 'pages_unique_url', count(*) - count(DISTINCT url), count(*) FROM pages
UNION ALL SELECT 'pages_html_not_null', count(*) FILTER (WHERE html IS NULL), count(*) FROM pages
UNION ALL SELECT 'graph_unique_url', count(*) - count(DISTINCT page_url), count(*) FROM stored
UNION ALL SELECT 'graph_unique_page_id', count(*) - count(DISTINCT page_url), count(*) FROM stored
UNION ALL SELECT 'graph_edge_source_fk', count(*) FILTER (WHERE source_url NOT IN (SELECT page_url FROM stored)), count(*) FROM edges
UNION ALL SELECT 'graph_edge_target_fk', count(*) FILTER (WHERE target_url NOT IN (SELECT page_url FROM stored)), count(*) FROM edges
UNION ALL SELECT 'graph_edge_pk', count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM edges)), count(*) FROM edges
UNION ALL SELECT 'index_unique_term', count(*) - count(DISTINCT term), count(*) FROM terms
UNION ALL SELECT 'index_term_id_unique', count(*) - count(DISTINCT term), count(*) FROM terms
UNION ALL SELECT 'index_posting_pk', count(*) - (SELECT count(*) FROM (SELECT DISTINCT term, page_id FROM postings)), count(*) FROM postings
UNION ALL SELECT 'index_posting_page_fk', count(*) FILTER (WHERE page_id NOT IN (SELECT page_id FROM docs)), count(*) FROM postings
UNION ALL SELECT 'index_total_pages_not_null', count(*) FILTER (WHERE total_pages IS NULL), count(*) FROM terms
UNION ALL SELECT 'index_total_pages_matches', count(*) FILTER (WHERE coalesce(n, 0) <> total_pages), count(*)
          FROM terms LEFT JOIN pcount USING (term)"""



# --- streaming ---------------------------------------------------------------------------

SQL["ingest_batches"] = SQL["pages_with_stubs"]

SQL["seen_stream"] = f"""WITH {PTEXT}, nonempty AS (SELECT * FROM ptext WHERE length(text) > 0)
SELECT DISTINCT outlink AS url FROM ({outlinks('nonempty')})"""

SQL["incremental_index"] = f"""WITH {DOCS},
chunked AS (SELECT page_id, page_content, CAST(floor(page_id / 750) AS BIGINT) AS chunk FROM docs),
tok AS (SELECT chunk, page_id, lower(unnest(regexp_extract_all(translate(regexp_replace(
          page_content, '[^\\x00-\\x7F]', '', 'g'), {P}, {SP}), {PAT}))) AS term
        FROM chunked WHERE page_content IS NOT NULL),
occ AS (SELECT * FROM tok WHERE {KEEP_OCC}),
pt AS (SELECT chunk, term, page_id, count(*) AS occurrences FROM occ GROUP BY ALL),
st AS (SELECT chunk, term, sum(occurrences) AS occurrences FROM pt GROUP BY ALL),
kept AS (SELECT chunk, term FROM st WHERE (length(term) > 3 AND length(term) < 15) OR occurrences > 20),
post AS (SELECT DISTINCT pt.term, pt.page_id FROM pt JOIN kept USING (chunk, term))
SELECT term, count(*) AS total_pages FROM post GROUP BY term"""

SQL["links_replaced"] = f"""WITH {INGEST}
SELECT url AS source_url, outlink AS target_url FROM l1 WHERE url NOT IN (SELECT url FROM r2)
UNION SELECT url, outlink FROM l2"""

SQL["budget_rounds"] = f"""WITH b AS (SELECT page_id, url, html, page_id AS seq FROM pages),
f AS ({fixture('b')}),
r AS (SELECT * FROM (SELECT page_id, url, seq, html, {text_twin('html')} AS text FROM f WHERE {GOOD}) WHERE length(text) > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY page_id % 2, seq, url) AS fetch_rank FROM r),
em AS (SELECT seq, url, html FROM ranked WHERE fetch_rank <= (SELECT 3 * count(*) // 10 FROM pages))
SELECT DISTINCT url AS source_url, outlink AS target_url FROM ({outlinks('em', 'seq')})"""

# the last version of each document; the rare-term rule inside each chunk
SQL["search_streamed"] = f"""WITH docs AS (SELECT doc_id AS page_id, 'doc/' || CAST(doc_id AS VARCHAR) AS page_url,
  CASE WHEN length(text) > 500 THEN substr(text, length(text) // 2 + 1) ELSE text END AS page_content FROM documents),
occ AS (SELECT *, page_id // 750 AS chunk FROM ({idx_tokens('docs')}) WHERE {KEEP_OCC}),
pt AS (SELECT chunk, term, page_id, count(*) AS occurrences FROM occ GROUP BY ALL),
kept AS (SELECT chunk, term FROM pt GROUP BY ALL HAVING (length(term) > 3 AND length(term) < 15) OR sum(occurrences) > 20),
postings AS (SELECT term, page_id FROM pt SEMI JOIN kept USING (chunk, term)),
terms AS (SELECT term, count(*) AS total_pages FROM postings GROUP BY term), {BENCH_Q},
{weight_ctes('bench_q', 'docs', 'terms')},
{score_ctes('docs', 'postings')}
{_top_k(20)}"""

def _generations(rounds: int = 8, keep: int = 3) -> str:
    """A round at a time: s the open generation, e what is given out, n how much, seen and sizes all so far."""
    steps = []
    for k in range(rounds):
        if k == 0:
            steps.append("s0 AS (SELECT 0 AS g)")
            known = "(SELECT NULL AS url WHERE false)"
        else:
            steps.append(f"s{k} AS (SELECT CASE WHEN sum(n) >= (SELECT c FROM cap) THEN g + 1 ELSE g END AS g FROM sizes{k - 1} "
                         f"WHERE g = (SELECT max(g) FROM sizes{k - 1}) GROUP BY g)")
            known = f"(SELECT url FROM seen{k - 1} WHERE g > (SELECT g FROM s{k}) - {keep})"
        steps.append(f"e{k} AS MATERIALIZED (SELECT DISTINCT f.url, s.g FROM found f, s{k} s WHERE f.k = {k} AND f.url NOT IN {known})")
        steps.append(f"n{k} AS (SELECT s.g, (SELECT count(*) FROM e{k}) AS n FROM s{k} s)")
        for all_, one in (("seen", "e"), ("sizes", "n")):
            steps.append(f"{all_}{k} AS MATERIALIZED (SELECT * FROM {one}{k}" + (f" UNION ALL SELECT * FROM {all_}{k - 1})" if k else ")"))
    return f"""WITH {PTEXT}, nonempty AS (SELECT * FROM ptext WHERE length(text) > 0),
found AS MATERIALIZED (SELECT outlink AS url, page_id % {rounds} AS k FROM ({outlinks('nonempty')})),
cap AS (SELECT greatest(1, count(DISTINCT url) // 10) AS c FROM found),
{", ".join(steps)}
SELECT url, count(*) AS times FROM seen{rounds - 1} GROUP BY url"""


SQL["seen_generations"] = _generations()

SQL["search_indexed"] = SQL["search_documents"]
SQL["search_pruned"] = SQL["search_documents"]


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
