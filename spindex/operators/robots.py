"""robots.txt files as tables: lines -> directives -> groups -> rules and delay per host.

Every file is exploded into its lines; windows over a host's lines (one file each,
of bounded size) number the groups, and aggregations pick the group that decides
access and the one that sets the pace.  All of it is DataFrame expressions.

Format.  A group is a run of ``User-agent`` lines and the rules and paces after it,
up to the next such run or an empty line; lines outside a group, comments and unknown
fields are left out, and agents without any line of their own make no group.  The
first group for ``*`` is the default; a group that names an agent comes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindex.functions.constants import ROBOTS_ACCESS_AGENT

DEFAULT_AGENT = "spindexbot/1.0"

# The breaks between lines, and the fields that count.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
FIELD_KINDS = {"user-agent": "agent", "allow": "rule", "disallow": "rule", "crawl-delay": "pace", "request-rate": "pace"}
ROBOTS_TYPE = "STRUCT<rate_limit: DOUBLE, rules: ARRAY<STRUCT<idx: INT, allow: BOOLEAN, path: STRING>>>"


def quote_path(col: Column) -> Column:
    """Percent-encoding of a path (all but letters, digits and ``_.-~/``)."""
    enc = F.url_encode(col)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def unquote(col: Column) -> Column:
    """Percent escapes decoded; a percent sign that starts none, and a plus sign, stand for themselves."""
    kept = F.replace(F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), col)


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def rule_path(value: Column) -> Column:
    """The path of a rule as request paths are written: without empty fragment, query and parameters, re-quoted."""
    path = F.regexp_replace(F.regexp_replace(value, "#$", ""), r"\?$", "")
    return quote_path(F.regexp_replace(path, r"^((?:[^?#]*/)?[^/;?#]*);(?=[?#]|$)", "$1"))


def directives(robots: DataFrame) -> DataFrame:
    """``robots(host_key, text)`` -> ``(host_key, line, kind, field, value)``: empty lines and known fields."""
    lines = robots.select("host_key", F.posexplode(F.split("text", LINE_BREAK, -1)).alias("line", "raw"))
    body = _strip(F.substring_index("raw", "#", 1))
    cut = F.instr("body", ":")
    parts = lines.withColumn("body", body) \
        .withColumn("field", F.when(cut > 0, F.lower(_strip(F.substr("body", F.lit(1), cut - 1))))) \
        .withColumn("value", F.when(cut > 0, unquote(_strip(F.substr("body", cut + 1)))))
    kind = F.when(F.col("raw") == "", F.lit("empty"))
    for field, name in FIELD_KINDS.items():
        kind = kind.when(F.col("field") == field, F.lit(name))
    return parts.select("host_key", "line", kind.alias("kind"), "field", "value").where("kind IS NOT NULL")


def groups(lines: DataFrame) -> DataFrame:
    """``(host_key, group, agents, rules, delay, seconds, requests)`` of every group that has a line of its own."""
    upto = Window.partitionBy("host_key").orderBy("line")
    opened = F.last(F.when(F.col("kind").isin("empty", "agent"), F.col("kind")), ignorenulls=True).over(upto)
    first = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(upto), F.lit("empty")) != "agent")
    inside = lines.withColumn("opened", opened).withColumn("first", first.cast("int")) \
        .withColumn("group", F.sum("first").over(upto)).where("opened = 'agent' AND kind <> 'empty'")
    field, value, at = F.col("field"), F.col("value"), F.col("line")
    rule = F.struct(at.alias("at"), ((field == "allow") | (value == "")).alias("allow"), rule_path(value).alias("path"))
    rate = r"^\s*([0-9]+)\s*/\s*([0-9]+)\s*$"
    delay = F.when((field == "crawl-delay") & value.rlike("^[0-9]+$"), value.cast("double"))
    paced = F.when((field == "request-rate") & value.rlike(rate), F.struct(
        F.regexp_extract(value, rate, 1).try_cast("double").alias("requests"),
        F.regexp_extract(value, rate, 2).try_cast("double").alias("seconds")))
    found = inside.withColumns({"rule": F.when(F.col("kind") == "rule", rule), "delay": delay, "paced": paced}) \
        .groupBy("host_key", "group").agg(
            F.collect_set(F.when(F.col("kind") == "agent", value)).alias("agents"),
            F.array_sort(F.collect_list("rule")).alias("rules"),
            F.max(F.when(F.col("delay").isNotNull(), F.struct("line", "delay"))).alias("delay"),
            F.max(F.when(F.col("paced").isNotNull(), F.struct("line", "paced"))).alias("paced"),
            F.count_if(F.col("kind") != "agent").alias("own"))
    return found.where("own > 0").select("host_key", "group", "agents", "rules", F.col("delay.delay").alias("delay"),
                                         F.col("paced.paced.seconds").alias("seconds"), F.col("paced.paced.requests").alias("requests"))


def seconds_between(delay: Column, seconds: Column, requests: Column) -> Column:
    """The larger of a delay and of seconds per request; what is absent or 0 does not count; 0 without either."""
    def some(x):
        return F.nullif(x, F.lit(0.0))
    return F.coalesce(F.greatest(some(delay), some(seconds) / some(requests)), F.lit(0.0))


def robots_rules(robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """``(host_key, robots STRUCT<rate_limit, rules>, ok)`` per host.

    ``robots(host_key, ok, text, fetched_at)``: the first fetch per host is kept for the whole run (a
    cache; failures are cached as "no rules").  The struct is null when there are no rules: a failed
    fetch, or none of a text.  Access rules are those that hold for any agent, the pace is that of ``agent``.
    """
    first = robots.groupBy("host_key").agg(F.min_by(F.struct("ok", "text"), F.col("fetched_at")).alias("r")) \
        .select("host_key", F.col("r.ok").alias("ok"), F.col("r.text").alias("text"))
    usable = F.coalesce("ok", F.lit(False)) & F.col("text").isNotNull()
    token = F.lit(agent.split("/")[0].lower())
    general = F.array_contains("agents", ROBOTS_ACCESS_AGENT)
    paced = F.exists("agents", lambda a: token.contains(F.lower(a)))
    unnamed = F.array_contains("agents", "")

    def chosen(named: Column, payload: Column) -> Column:
        """Of the groups that apply, the first named one, else the first general one."""
        turn = F.when(general, F.lit(1)).when(named, F.lit(0))
        return F.min(F.when(turn.isNotNull(), F.struct(turn.alias("turn"), F.col("group"), payload.alias("payload"))))["payload"]

    limit = F.struct(seconds_between(F.col("delay"), F.col("seconds"), F.col("requests")).alias("limit"))
    decided = groups(directives(first.where(usable))).groupBy("host_key") \
        .agg(chosen(unnamed, F.struct("rules")).alias("access"), chosen(paced, limit).alias("pace"))
    rules = F.transform(F.coalesce("access.rules", F.array()),
                        lambda r, i: F.struct(i.alias("idx"), r["allow"].alias("allow"), r["path"].alias("path")))
    found = F.struct(F.coalesce("pace.limit", F.lit(0.0)).alias("rate_limit"), rules.alias("rules")).cast(ROBOTS_TYPE)
    return first.withColumn("usable", usable).drop("text").join(decided, "host_key", "left") \
        .select("host_key", F.when(F.col("usable"), found).alias("robots"), "ok")
