"""URL filters by a temporal list join.

A list is a log of dated events: a pattern is set to block or allow, or taken
off. Each pattern's events become validity intervals; an as-of join judges a
capture by the entries that were active when it was fetched. Patterns are
domains (they cover their subdomains) or host directories; of the active
entries the most specific one decides.

The as-of join carries the state of each pattern into the days on which it was
asked for, so that captures meet only the intervals of their key and day, and
need no order among themselves: a hot host is joined like any other, and a
pattern with a long history costs its captures nothing. Captures that agree in
URL and time are judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Staging

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def pattern_keys(url: Column) -> Column:
    """The keys of a URL: 'd:' and each domain of two labels or more, 'p:' host and each directory."""
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.concat(F.lit("p:"), host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.concat(domains, F.when(F.size(parts) > 1, folders).otherwise(none)))


def clean_events(events: DataFrame) -> DataFrame:
    """events(key, verdict, at) without nulls and unknown verdicts; of events at one time the last by name holds."""
    known = events.select("key", "verdict", "at").where("key is not null and at is not null and verdict in ('block', 'allow', 'remove')")
    return known.groupBy("key", "at").agg(F.max("verdict").alias("verdict"))


def validity(events: DataFrame, days: DataFrame) -> DataFrame:
    """Validity intervals (key, day, start, stop, verdict) of clean_events, for the days(key, day) that are asked for.

    Each begins at an event, or at the start of a day with the state carried
    into it; it holds up to, not including, its stop. Intervals without a
    state, or after a removal, are left out.
    """
    kind = events.schema["at"].dataType
    marks = days.select("key", F.col("day").cast(kind).alias("at"), F.lit(None).cast("string").alias("verdict"))
    both = events.select("key", "at", "verdict").unionByName(marks).groupBy("key", "at").agg(F.max("verdict").alias("verdict"))
    w = Window.partitionBy("key").orderBy("at")  # the events of one pattern, and a row a day: no captures
    held = F.last("verdict", ignorenulls=True).over(w)
    rows = both.select("key", F.to_date("at").alias("day"), F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), held.alias("verdict"))
    return rows.where("verdict <> 'remove'")


def filter_urls(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with entry, verdict and kept behind their own columns (which lose any of these names).

    entry: the most specific key active at the fetch, directories before
    domains and longer before shorter; verdict: its block or allow; kept: not
    blocked. verdict of events: block, allow or remove; events with a null in
    any column are ignored. A null or hostless URL, or a null time, meets no
    entry and is kept. Repeated captures get equal verdicts; other columns may
    have any names; an empty list keeps everything.
    """
    st = Staging(captures.sparkSession, "urls")
    captures = captures.drop("entry", "verdict", "kept")
    captures = captures.select(F.struct(*captures.columns).alias("row"), F.col(url_col).alias("url"), F.col(time_col).alias("at"))
    events = clean_events(events)
    asked = captures.where("url is not null and at is not null").groupBy("url", "at").agg(F.lit(1).alias("n"))
    asked = asked.select("url", "at", F.to_date("at").alias("day"), F.explode(pattern_keys(F.col("url"))).alias("key"))
    asked = st.put(asked.join(events.select("key").distinct(), "key", "left_semi"), "asked")
    met = asked.join(validity(events, asked.select("key", "day").distinct()), ["key", "day"])
    met = met.where((F.col("at") >= F.col("start")) & (F.col("stop").isNull() | (F.col("at") < F.col("stop"))))
    rank = F.struct(F.substring("key", 1, 1).alias("kind"), F.length("key").alias("n"), "key", "verdict")
    best = met.groupBy("url", "at").agg(F.max(rank).alias("r")).select("url", "at", F.col("r.key").alias("entry"), F.col("r.verdict").alias("verdict"))
    out = captures.join(st.put(best, "best"), ["url", "at"], "left")
    return out.select("row.*", "entry", "verdict", F.coalesce(F.col("verdict") != "block", F.lit(True)).alias("kept"))
