"""Dated URL lists: every capture is judged by the entries that held when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegauge.functions.columns import quoted
from framegauge.llm.native import let, measured
from framegauge.session import checkpointed

KINDS = ("allow", "block")
# Fixed value: the longest name that DNS admits.
MAX_HOST = 253
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
USER = r"(?:[^/?#@]*@)?"


def url_host(url: Column) -> Column:
    """Lower-case host without user, port, leading www. and trailing dots; null without one."""
    host = F.lower(F.regexp_extract(url, SCHEME + USER + r"([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.|\.+$", "")
    return F.when((host != "") & (F.length(host) <= MAX_HOST), host)


def url_section(url: Column) -> Column:
    """First part of the path, null if there is none."""
    return F.nullif(F.regexp_extract(url, SCHEME + r"[^/?#]*/([^/?#]+)", 1), F.lit(""))


def url_patterns(url: Column) -> Column:
    """Entries that would match a URL: its host and every parent domain of two labels or
    more (the bare host if it has one label), and host/section.  Empty without a host."""
    def domains(host: Column) -> Column:
        labels = F.split(host, r"\.")
        return let(labels, lambda names: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(names, i, F.size(names)), ".")))

    host = url_host(url)
    section = F.concat_ws("/", host, url_section(url))
    every = F.concat(domains(host), F.when(url_section(url).isNotNull(), F.array(section)).otherwise(F.array().cast("array<string>")))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def entry_pattern(pattern: Column) -> Column:
    """A list entry as captures are matched: host, or host/section, without scheme, user,
    port, leading www. and trailing dots, the host in lower case.  Null where nothing can
    match: no host, or a path of more than one part."""
    bare = F.regexp_replace(F.trim(pattern), SCHEME + USER, "")
    host = url_host(F.concat(F.lit("x://"), bare))
    path = F.regexp_extract(bare, r"^[^/?#]*/+([^?#]*?)/*(?:[?#].*)?$", 1)
    return F.when(path == "", host).when(~path.contains("/"), F.concat(host, F.lit("/"), path))


def _states(entries: DataFrame) -> DataFrame:
    """One row per (pattern, kind, at): whether the entry stands from then on.  At one time
    a removal comes after an addition.  Incomplete and unknown entries are left out."""
    normal = entries.select(entry_pattern(F.col("pattern")).alias("pattern"), "kind", "action", "at")
    known = normal.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("pattern").isNotNull()
                          & F.col("at").isNotNull())
    return known.groupBy("pattern", "kind", "at").agg((F.max("action") == "add").alias("on")).withColumn(
        "day", F.to_date("at"))


def active_intervals(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, kind, day, since, until): when entries stood, cut at the bounds of the days
    that ``wanted`` (pattern, day) names.

    The state at the start of a day is the last one of an earlier day, an as-of join
    over one row per pattern and day.  Within a day the entry's own log decides.  So a
    window never holds more than a pattern's days, or a pattern's changes in one day.
    """
    states = checkpointed(_states(entries))
    asked = wanted.select("pattern", "day", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    closing = states.groupBy("pattern", "kind", "day").agg(F.max_by("on", "at").alias("on"))
    days = asked.select("pattern", "kind", "day", F.lit(None).cast("boolean").alias("on"), F.lit(True).alias("asked")).unionByName(
        closing.withColumn("asked", F.lit(False)))
    earlier = Window.partitionBy("pattern", "kind").orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    opening = days.withColumn("number", F.unix_date("day")).withColumn(
        "on", F.last("on", ignorenulls=True).over(earlier)).where("asked")
    starts = opening.select("pattern", "kind", "day", F.col("day").cast("timestamp").alias("at"),
                            F.coalesce("on", F.lit(False)).alias("on"), F.lit(0).alias("step"))
    changes = states.join(asked, ["pattern", "kind", "day"], "left_semi").select(
        "pattern", "kind", "day", "at", "on", F.lit(1).alias("step"))
    log = Window.partitionBy("pattern", "kind", "day").orderBy("at", "step")
    return starts.union(changes).withColumn("until", F.lead("at").over(log)).where("`on`").select(
        "pattern", "kind", "day", F.col("at").alias("since"),
        F.coalesce("until", F.date_add("day", 1).cast("timestamp")).alias("until"))


def temporal_url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with host, matched (pattern), verdict (allow, block or none) and kept.

    ``entries`` has pattern, kind (allow or block), action (add or remove) and at.  An
    entry holds from an addition up to the next removal of the same pattern and kind,
    that instant excluded.  Of the entries that hold when a URL was fetched the most
    specific decides: host/section before hosts, then the longer host; allow before
    block on the same pattern.  Columns of the new names are replaced, all others passed
    through whatever their names.  Entries are written like URLs or bare
    (``entry_pattern``); ``unmatchable_entries`` has those that no capture can match.

    A URL without host, or a null URL or time, has the verdict none.  Captures are kept
    unless blocked.  Repeated captures are judged alike, once.  Times are compared by
    UTC days of the session's time zone.  Built-in expressions only; a hot host is a
    skewed partition of an equi-join on pattern and day, which can be split.
    """
    kept = [c for c in captures.columns if c not in ("host", "matched", "verdict", "kept")]
    source = captures.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)], quoted(url).alias("u"), quoted(fetched).alias("f"))
    asked = checkpointed(source.select(F.col("u").alias("url"), F.col("f").alias("t")).where("url is not null and t is not null").distinct())
    keys = asked.select("url", "t", F.to_date("t").alias("day"), F.explode(url_patterns(F.col("url"))).alias("pattern"))
    listed = entries.select(entry_pattern(F.col("pattern")).alias("pattern")).where("pattern is not null").distinct()
    keys = checkpointed(keys.join(measured(listed, F.octet_length("pattern")), "pattern", "left_semi"))
    spans = checkpointed(active_intervals(entries, keys.select("pattern", "day").distinct()))
    hits = keys.join(spans, ["pattern", "day"]).where("since <= t and t < until")
    rank = F.struct(F.col("pattern").contains("/").alias("path"), F.length("pattern").alias("size"), F.col("pattern").alias("pattern"),
                    (F.col("kind") == "allow").alias("allow"))
    best = hits.groupBy("url", "t").agg(F.max(rank).alias("best"))
    verdict = F.when(F.col("best").isNull(), "none").when(F.col("best.allow"), "allow").otherwise("block")
    return source.join(best, (F.col("u") == F.col("url")) & (F.col("f") == F.col("t")), "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], url_host(F.col("u")).alias("host"), F.col("best.pattern").alias("matched"),
        verdict.alias("verdict"), (verdict != "block").alias("kept"))


def unmatchable_entries(entries: DataFrame) -> DataFrame:
    """The entries that can match no capture: no host, a longer path, an unknown kind or action, no time."""
    known = F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("at").isNotNull()
    return entries.where(~F.coalesce(known & entry_pattern(F.col("pattern")).isNotNull(), F.lit(False)))
