"""URL helpers as Column expressions.

Outlink filter and resolution, query-string canonicalisation, host keys,
registrable domains and robots URLs.  All native except ``urljoin`` for
links that are neither empty, absolute https, nor plain root-relative: those
go through an Arrow-batched UDF so the result equals the standard
library's ``urljoin`` exactly.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindex.functions.constants import (
    DEFAULT_PUBLIC_SUFFIXES, MAX_LINK_LEN, SKIPPED_LINK_MARKERS,
    SKIPPED_LINK_SUFFIXES, TRACKING_PARAMS,
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- outlinks ----------------------------------------------------------------

def strip_trailing_slashes(col) -> Column:
    return F.regexp_replace(_c(col), "/+$", "")


def keep_outlink(href) -> Column:
    """Outlink filter on a raw ``href``.

    Null/empty hrefs are skipped; then, on the href with trailing slashes
    removed: length below 750, no skipped file suffix (case-sensitive, tested
    before the fragment is cut), and none of the mail/phone markers anywhere.
    """
    h = _c(href)
    link = strip_trailing_slashes(h)
    ok = h.isNotNull() & (h != "") & (F.length(link) < MAX_LINK_LEN)
    for suffix in SKIPPED_LINK_SUFFIXES:
        ok = ok & ~link.endswith(suffix)
    for marker in SKIPPED_LINK_MARKERS:
        ok = ok & ~link.contains(marker)
    return ok


@F.arrow_udf(T.StringType())
def _urljoin_udf(base: pa.Array, link: pa.Array) -> pa.Array:
    out = []
    for b, u in zip(base.to_pylist(), link.to_pylist()):
        try:
            out.append(None if b is None or u is None else urljoin(b, u))
        except ValueError:  # no URL at all, e.g. an open bracket in the host
            out.append(None)
    return pa.array(out, pa.string())


def resolve_outlink(base, href) -> Column:
    """Absolute outlink for a kept ``href`` seen on page ``base``.

    Trailing slashes removed, cut at the first ``#``; a link that contains
    ``https://`` anywhere is used as is, every other link is joined with the
    base URL (``urljoin``).  Empty and plain root-relative links are resolved
    natively; the rest takes the UDF's path, among it links with an empty
    query or empty parameters, which the join drops.  Null: not a URL.
    """
    b = _c(base)
    link = F.substring_index(strip_trailing_slashes(href), "#", 1)
    origin = F.regexp_extract(b, r"^(https?://[^/?#]*)", 1)
    plain_root = (link.rlike(r"^/[^/\s.][^\t\r\n]*$") & ~link.contains("/.")
                  & ~link.rlike(r"\?$|;(\?|$)") & (origin != ""))
    absolute = link.contains("https://")
    slow = ~absolute & (link != "") & ~plain_root
    return (F.when(absolute, link)
            .when(link == "", b)
            .when(plain_root, F.concat(origin, link))
            .otherwise(_urljoin_udf(F.when(slow, b), F.when(slow, link))))


# --- canonical URL --------------------------------------------------------------

def _quote_plus(col) -> Column:
    # url_encode follows java.net.URLEncoder, which differs from quote_plus
    # only in '*' (kept there, escaped here) and '~' (escaped there, kept here).
    enc = F.url_encode(col)
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _unquote_plus(col) -> Column:
    # escapes are decoded one by one: a percent sign that starts none stands for itself
    return F.try_url_decode(F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(col, blocked=TRACKING_PARAMS) -> Column:
    """URL without tracking parameters and blank values.

    The query is split on ``&``; pairs without ``=`` or with an empty value
    are dropped; keys and values are decoded; pairs whose lower-cased key is
    in ``blocked`` are removed; repeated keys are grouped at the position of
    their first occurrence; the query is re-encoded (``quote_plus``).  Empty
    parameters (a last ``;`` of the path), an empty query or an empty fragment
    are dropped from the rebuilt URL, the scheme is lower-cased, and leading
    blanks, tabs and line breaks are no part of it.
    """
    url = F.regexp_replace(F.regexp_replace(_c(col), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    pre = F.substring_index(url, "#", 1)
    frag = F.when(url.contains("#"), F.substring(url, F.instr(url, "#") + 1, 1 << 30))
    base = F.regexp_replace(F.substring_index(pre, "?", 1),
                            r"^((?:[A-Za-z][A-Za-z0-9+.\-]*+:)?+(?://[^/]*+)?+(?:.*/)?[^/;]*);$", "$1")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    base = F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + 1))
    query = F.when(pre.contains("?"), F.substring(pre, F.instr(pre, "?") + 1, 1 << 30)).otherwise("")
    raw = F.filter(F.split(query, "&"), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(raw, lambda p: F.struct(
        _unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
        F.substring(p, F.instr(p, "=") + 1, 1 << 30).alias("raw_v")))
    pairs = F.filter(pairs, lambda p: (p["raw_v"] != "")
                     & ~F.lower(p["k"]).isin(list(blocked)))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    encoded = F.flatten(F.transform(keys, lambda k: F.transform(
        F.filter(pairs, lambda p: p["k"] == k),
        lambda p: F.concat(_quote_plus(p["k"]), F.lit("="), _quote_plus(_unquote_plus(p["raw_v"]))))))
    new_query = F.array_join(encoded, "&")
    return F.concat(base,
                    F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(""),
                    F.when(F.coalesce(frag, F.lit("")) != "", F.concat(F.lit("#"), frag)).otherwise(""))


# --- hosts and domains ------------------------------------------------------------

def url_host(col) -> Column:
    """Lower-cased host: after an optional ``scheme://``, without user info,
    port and trailing dots."""
    rest = F.regexp_replace(_c(col), r"^(?i)(?:[a-z][a-z0-9+.\-]*:)?//", "")
    netloc = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(netloc, r"^.*@", "")
    host = F.regexp_replace(host, r":[0-9]*$", "")
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


# Names that are no public top-level domains (reserved, or in private use).
RESERVED_NAMES = ("test", "example", "invalid", "localhost", "local", "internal", "lan", "home", "corp")
_TOP_LEVEL = rf"(?!(?:{'|'.join(RESERVED_NAMES)})$)(?:[a-z]{{2,63}}|xn--[a-z0-9\-]+)"


def suffix_alternation(suffixes=DEFAULT_PUBLIC_SUFFIXES) -> str:
    """Regex alternation of public suffixes, longest first.  ``*.x`` rules
    become ``[^.]+\\.x``.

    The built-in list cannot name every top-level domain, so with it any other
    alphabetic top-level name that is not reserved is a suffix too; a list
    that is passed holds by itself (:mod:`spindex.operators.domains` takes a
    full one as a table).
    """
    parts = []
    for s in sorted({s.strip().lower() for s in suffixes if s and s.strip()}, key=lambda x: (-len(x), x)):
        if s.startswith("!"):
            continue
        parts.append(r"[^.]+\." + re.escape(s[2:]) if s.startswith("*.") else re.escape(s))
    if suffixes is DEFAULT_PUBLIC_SUFFIXES:
        parts.append(_TOP_LEVEL)
    return "|".join(parts)


def domain_of_host(host, suffixes=DEFAULT_PUBLIC_SUFFIXES) -> Column:
    """Domain one label below the longest public suffix of a host; empty when
    the host has no label above a public suffix (localhost, IPs, a bare suffix)."""
    alts = suffix_alternation(suffixes)
    host = _c(host)
    top = F.regexp_extract(host, f"([^.]+\\.(?:{alts}))$", 1)
    return F.when(host.rlike(f"^(?:{alts})$"), F.lit("")).otherwise(top)


def registrable_domain(col, suffixes=DEFAULT_PUBLIC_SUFFIXES) -> Column:
    """:func:`domain_of_host` of the URL's host."""
    return domain_of_host(url_host(col), suffixes)


def url_fqdn(col, suffixes=DEFAULT_PUBLIC_SUFFIXES) -> Column:
    host = url_host(col)
    return F.when(registrable_domain(col, suffixes) != "", host).otherwise(F.lit(""))


def host_key_of(url, host, domain) -> Column:
    """``https://`` when ``https`` occurs anywhere in the URL, else ``http://``,
    followed by the host (empty when it has no registrable domain)."""
    scheme = F.when(_c(url).contains("https"), F.lit("https://")).otherwise(F.lit("http://"))
    return F.concat(scheme, F.when(_c(domain) != "", _c(host)).otherwise(F.lit("")))


def host_key(col, suffixes=DEFAULT_PUBLIC_SUFFIXES) -> Column:
    """:func:`host_key_of` of a URL alone."""
    return host_key_of(col, url_host(col), registrable_domain(col, suffixes))


def robots_url(host_key_col) -> Column:
    return F.concat(_c(host_key_col), F.lit("/robots.txt"))


def host_of_robots_url(col) -> Column:
    return F.regexp_replace(_c(col), r"/robots\.txt$", "")
