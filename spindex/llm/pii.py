"""Personal data by bootstrapped contextual extraction.

Method.  Base expressions (e-mail, IP address, payment card, phone) give seed
entities.  What stands in front of an entity - its last one and two words with
the punctuation that leads to it - is a lexical pattern.  Other
identifier-like strings (with ``MIN_DIGITS`` digits at least) are open
instances.  Over the graph of patterns and instances, gathered from all texts,
Spark scores in rounds, until hardly anything changes or ``ROUNDS`` have passed,

    pattern, kind:         sum of the kind's instance scores / (distinct instances + 1)
    open instance, kind:   the best score of its patterns in the round before

where seeds keep score 1, and an open instance starts with ``PRIOR`` for each kind
whose shape it has (``SHAPES``) and keeps 0 for the others.  So what looks like the
kind is no evidence against a pattern, unless entities are few beside it.  A pattern is
accepted with a score of ``MIN_SCORE`` and a support of ``MIN_SUPPORT``, the summed scores
of the entities behind it.  Open instances behind an accepted pattern become entities of
its kind, beside the base ones, and support further patterns with their scores: the
bootstrap goes on from identifier to pattern to identifier.

Texts are read once; what leaves that pass is a few identifiers per text, and
a frequent pattern is summed up before the shuffle.

Defined cases: null text is empty (no spans); repeated rows each get their
spans (counted once as evidence, since instances are distinct); positions are
code points, ends exclusive; an open instance never overlaps a base entity.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindex.session import materialize

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS = 4
MIN_LENGTH = 6
MAX_LENGTH = 64
ROUNDS = 6
SETTLED = 0.005  # the relative change of all scores below which no further round is made
MIN_SCORE = 0.8
MIN_SUPPORT = 5.0
PRIOR = 0.5
# What an open instance must look like to be of a kind: an expression, and the numbers of digits.
SHAPES = ((r"^[^@]+@[^@]+$", 0, 64), (r"^[0-9]+([.][0-9]+){3}$", 4, 16), (r"^[0-9-]+$", 12, 19), (r"^[0-9+./-]+$", 6, 15))
REACH = 48  # characters in front of an entity that a pattern is read from

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[A-Za-z0-9._@+/-]+")
_RUN_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._@+/-"
_BEFORE = re.compile(r"(?:([^\W\d_]+)[^\w\n]{1,3})?([^\W\d_]+)([^\w\n]{0,3})$")

_SPAN = "struct<start:int,kind:int,end:int>"
_SEEN = "struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base entities, sorted."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # each match holds one @: its local part is the run of local characters before it
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def open_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like runs that overlap no base entity."""
    out, free, k = [], 0, 0
    m = _DIGIT.search(text)
    while m:
        run = text[free:m.start()]
        start = free + len(run.rstrip(_RUN_CHARS))
        free = _RUN.match(text, start).end()
        core = text[start:free].strip("./-+@_")
        start = text.index(core, start) if core else start
        end = start + len(core)
        while k < len(taken) and taken[k][2] <= start:
            k += 1
        clash = any(s < end and start < e for s, _, e in taken[k:k + 4])
        if MIN_LENGTH <= len(core) <= MAX_LENGTH and sum(map(str.isdigit, core)) >= MIN_DIGITS and not clash:
            out.append((start, end))
        m = _DIGIT.search(text, free)
    return out


def patterns(text: str, start: int) -> list[str]:
    """The lexical patterns in front of a position: last word, last two words, with what follows them."""
    m = _BEFORE.search(text[max(0, start - REACH):start])
    if not m:
        return []
    two, one, glue = m.groups()
    out = [f"{one.lower()}|{glue}"]
    return [*out, f"{two.lower()} {out[0]}"] if two else out


def extract_column(text: Column) -> Column:
    """Struct ``(base, seen)``: base spans, and all seeds and open instances with their patterns."""

    @F.arrow_udf(f"struct<base:array<{_SPAN}>,seen:array<{_SEEN}>>")
    def extracted(texts: pa.Array) -> pa.Array:
        base, seen = [], []
        for t in texts.to_pylist():
            t = t or ""
            spans = base_spans(t)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            all_ = [(s, e, k) for s, k, e in spans] + [(s, e, None) for s, e in open_spans(t, spans)]
            seen.append([{"start": s, "end": e, "kind": k, "instance": t[s:e].lower(), "patterns": patterns(t, s)}
                         for s, e, k in all_])
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()),
                         ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(span)), pa.array(seen, pa.list_(one))], ["base", "seen"])

    return extracted(F.coalesce(text, F.lit("")))


def accepted_patterns(seen: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE,
                      min_support: float = MIN_SUPPORT) -> DataFrame:
    """``(pattern, kind, score)`` over ``seen (kind, instance, patterns)``; one kind per pattern.

    An instance that is a seed anywhere counts as one everywhere.
    """
    edges = seen.where("size(patterns) > 0").select("instance", "kind", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    edges = materialize(edges, "pii-edges")
    seeds = edges.where("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("kind")) \
        .withColumn("score", F.lit(1.0))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    digits = F.length(F.regexp_replace("instance", "[^0-9]", ""))
    kinds = F.array(*[F.when(F.col("instance").rlike(e) & digits.between(low, high), F.lit(k)) for k, (e, low, high) in enumerate(SHAPES)])
    shaped = edges.join(seeds.select("instance"), "instance", "left_anti").select("pattern", "instance", F.explode(kinds).alias("kind")) \
        .where("kind IS NOT NULL")
    shaped = materialize(shaped, "pii-open")
    entities, scored, last = seeds, None, None
    for _ in range(rounds):
        # entities (seeds, and what accepted patterns have found) support the patterns they stand behind;
        # only patterns with an entity of a kind can be scored for it
        support = edges.select("pattern", "instance").join(entities, "instance").groupBy("pattern", "kind") \
            .agg(F.sum("score").alias("support")).join(sizes, "pattern")
        # open instances that are no entities yet count by their best pattern of the round before, else by their shape
        likely = shaped.join(entities.select("instance", "kind"), ["instance", "kind"], "left_anti")
        if scored is not None:
            found = shaped.join(scored.select("pattern", "kind", "score"), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("score"))
            likely = likely.join(found, ["instance", "kind"], "left")
        else:
            likely = likely.withColumn("score", F.lit(PRIOR))
        more = likely.groupBy("pattern", "kind").agg(F.sum(F.coalesce("score", F.lit(PRIOR))).alias("more"))
        scored = support.join(more, ["pattern", "kind"], "left") \
            .withColumn("score", (F.col("support") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + 1)).drop("more")
        scored = materialize(scored, "pii-patterns")
        good = scored.where((F.col("score") >= min_score) & (F.col("support") >= min_support))
        now = scored.agg(F.count("*"), F.count_if((F.col("score") >= min_score) & (F.col("support") >= min_support)),
                         F.coalesce(F.sum("score"), F.lit(0.0))).first()
        if last is not None and now[:2] == last[:2] and abs(now[2] - last[2]) <= SETTLED * last[2]:
            break
        last = now
        discovered = shaped.join(good.select("pattern", "kind", "score"), ["pattern", "kind"]) \
            .groupBy("instance").agg(F.expr("max(struct(score, -kind)) AS top")) \
            .select("instance", (-F.col("top.col2")).cast("int").alias("kind"), "top.score")
        entities = materialize(seeds.unionByName(discovered), "pii-entities")
    best = good.groupBy("pattern").agg(F.expr("max(struct(score, -kind)) AS top")) \
        .select("pattern", (-F.col("top.col2")).cast("int").alias("kind"), "top.score")
    best = materialize(best, "pii-patterns")
    return best


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         base_out: str = "base", spans_out: str = "spans") -> DataFrame:
    """``docs`` (the columns ``keep``, else all) with the columns ``base_out`` and ``spans_out``: arrays
    of ``(start, kind, end)``, sorted by start and kind; ``kind`` numbers ``KINDS``."""
    keep = docs.columns if keep is None else keep
    read = docs.withColumn("__x", extract_column(F.col(text_col))).select(*keep, "__x") \
        .withColumn("__row", F.monotonically_increasing_id())
    read = materialize(read, "pii-read")
    seen = read.select("__row", F.explode("__x.seen").alias("s")).select("__row", "s.*")
    best = accepted_patterns(seen)
    added = seen.where("kind IS NULL").drop("kind").withColumn("pattern", F.explode("patterns")).join(best, "pattern") \
        .groupBy("__row", "start", "end").agg(F.expr("max(struct(score, -kind)) AS top")) \
        .groupBy("__row").agg(F.collect_list(F.struct(F.col("start"), (-F.col("top.col2")).cast("int").alias("kind"), F.col("end"))).alias("__added"))
    added = materialize(added, "pii-added")  # its known size decides whether the texts have to move
    none = F.array().cast(f"array<{_SPAN}>")
    spans = F.sort_array(F.concat("__x.base", F.coalesce("__added", none)))
    return read.join(added, "__row", "left").select(*keep, F.col("__x.base").alias(base_out), spans.alias(spans_out))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every entity replaced by its kind, as ``<EMAIL>``; overlapping ones by the first's kind."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, ss in zip(texts.to_pylist(), spans.to_pylist()):
            if t is None or not ss:
                out.append(t)
                continue
            parts, end = [], 0
            for s in ss:
                if s["start"] >= end:
                    parts += [t[end:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                end = max(end, s["end"])
            out.append("".join([*parts, t[end:]]))
        return pa.array(out, pa.string())

    cols = docs.columns
    found = find(docs, text_col, base_out="__base", spans_out="__spans") \
        .withColumn(text_col, replaced(F.col(text_col), F.col("__spans")))
    if chars_col in cols:  # a text that did not change keeps the count it came with
        found = found.withColumn(chars_col, F.when(F.size("__spans") > 0, F.length(text_col).cast("bigint")).otherwise(F.col(chars_col)))
    return found.select(*cols)
