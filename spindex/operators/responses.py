"""Response filters: arrival, size, content type and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindex.functions.constants import MAX_RESPONSE_BYTES


def header(headers, name: str) -> Column:
    """Value of the first header whose name equals ``name`` ignoring case."""
    h = F.col(headers) if isinstance(headers, str) else headers
    hit = F.filter(F.map_entries(h), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(hit, F.lit(1))["value"]


def decode_body(col) -> Column:
    """Lenient UTF-8: invalid byte sequences become U+FFFD (binary input)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.make_valid_utf8(c.cast("string"))


def response_is_good(headers="headers") -> Column:
    """Size, type and language rules over the response headers.

    * ``Content-Length`` above 3 MiB rejects (equal passes); a present but
      non-integer value rejects this row only;
    * a non-empty ``Content-Type`` must contain ``text/html`` (case-sensitive);
    * a non-empty ``Content-Language`` must contain ``en``.
    Missing or empty type/language headers pass.
    """
    length = header(headers, "Content-Length")
    n = F.trim(length).try_cast("bigint")
    length_ok = length.isNull() | (n.isNotNull() & (n <= MAX_RESPONSE_BYTES))
    ctype = header(headers, "Content-Type")
    type_ok = ctype.isNull() | (ctype == "") | ctype.contains("text/html")
    lang = header(headers, "Content-Language")
    lang_ok = lang.isNull() | (lang == "") | lang.contains("en")
    return F.coalesce(length_ok & type_ok & lang_ok, F.lit(False))


def received(responses: DataFrame) -> DataFrame:
    """Drop responses that never arrived (status is not tested)."""
    return responses.where(F.col("received"))


def good_responses(responses: DataFrame) -> DataFrame:
    return received(responses).where(response_is_good("headers"))
