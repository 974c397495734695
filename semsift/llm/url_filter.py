"""URL filtering with dated lists (operator 6): a temporal list join.

Lists are logs of dated additions and removals of hosts and domains. The log becomes
disjoint validity intervals per list and entry; an as-of join then tests every capture
against the entries active on its fetch day. An entry matches its own host and every
host below it.

Captures are reduced to distinct (host, day) pairs before the join. Intervals and
captures meet on (entry, 32-day bucket): an interval is repeated for the buckets it
spans, so neither an entry with a long history nor a domain that holds a third of the
web pairs all of its rows with all of its intervals; intervals of an entry are disjoint,
so a pair matches at most one per list.

Nulls: a capture without a usable host or day matches nothing and is kept; list rows
without entry or day are ignored. Several changes of an entry on one day leave it out if
one of them is a removal. Repeated captures are judged each. Empty lists block nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semsift.llm.common import pick, stage

BUCKET_DAYS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: str | Column) -> Column:
    """Lower-case host without user, port and a final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def suffixes(host: str | Column) -> Column:
    """The host and all domains above it."""
    return _let(F.split(host, r"\."), lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")))


def validity_intervals(log: DataFrame, list_col: str = "list", entry_col: str = "entry",
                       day_col: str = "day", action_col: str = "action") -> DataFrame:
    """``(list, entry, from_day, to_day)``: active from ``from_day`` until before ``to_day``
    (null: for good)."""
    rows = pick(log, list=list_col, entry=entry_col, day=day_col, action=action_col) \
        .where(F.col("entry").isNotNull() & F.col("day").isNotNull())
    by_day = rows.groupBy("list", F.lower("entry").alias("entry"), "day").agg(
        F.min(F.coalesce(F.col("action") == "add", F.lit(False))).alias("active"))
    history = Window.partitionBy("list", "entry").orderBy("day")
    return by_day.withColumn("to_day", F.lead("day").over(history)).where("active") \
        .select("list", "entry", F.col("day").alias("from_day"), "to_day")


def judge_captures(captures: DataFrame, log: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` (url and day) with ``_u_host`` and ``_u_matches``: sorted ``list:entry``
    strings of the entries active on the capture's day."""
    rows = captures.withColumn("_u_host", host_of(F.col(f"`{url_col}`"))) \
        .withColumn("_u_day", F.col(f"`{day_col}`").cast("date"))
    bucket = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01")) / BUCKET_DAYS)
    seen = stage(rows.where(F.col("_u_host").isNotNull() & F.col("_u_day").isNotNull())
                 .select("_u_host", "_u_day").distinct(), "url-hosts")
    last = seen.agg(F.max("_u_day")).first()[0]
    keys = seen.select("_u_host", "_u_day", bucket(F.col("_u_day")).alias("bucket"),
                       F.explode(suffixes("_u_host")).alias("entry"))
    active = validity_intervals(log).where(F.col("from_day") <= F.lit(last))
    until = F.least(F.coalesce(F.date_sub("to_day", 1), F.lit(last)), F.lit(last))
    active = active.select("list", "entry", "from_day", "to_day", F.explode(
        F.sequence(bucket(F.col("from_day")), bucket(until))).alias("bucket"))
    hit = keys.join(active, ["entry", "bucket"]).where(
        (F.col("from_day") <= F.col("_u_day")) & (F.col("to_day").isNull() | (F.col("_u_day") < F.col("to_day"))))
    verdicts = stage(hit.groupBy("_u_host", "_u_day").agg(F.array_sort(F.collect_set(
        F.concat_ws(":", F.coalesce("list", F.lit("")), "entry"))).alias("_u_matches")), "url-verdicts")
    return rows.join(verdicts, ["_u_host", "_u_day"], "left").drop("_u_day")


def derived_log(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """A dated list log made of the captures' own hosts, for tables that come without one:
    a fixed share of the hosts and their domains, by the digits of their MD5, is added to
    the list ``spam`` or ``adult`` some day of 2024, and most are removed and some added again."""
    host = host_of(F.col(f"`{url_col}`"))
    entries = (captures.select(host.alias("h")).where("h is not null").distinct()
               .select(F.explode(F.slice(suffixes("h"), 1, 2)).alias("entry")).distinct())
    n = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("int")
    e = entries.withColumn("n", n).where("n % 5 < 2") \
        .withColumn("list", F.when(F.col("n") % 5 == 0, "spam").otherwise("adult")) \
        .withColumn("d", (F.floor(F.col("n") / 5) % 240).cast("int"))
    event = lambda action, shift: F.struct(
        F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("d") + shift).alias("day"))
    third = F.col("n") % 3
    log = F.when(third == 0, F.array(event("add", 0))) \
        .when(third == 1, F.array(event("add", 0), event("add", 10), event("remove", 40))) \
        .otherwise(F.array(event("add", 0), event("remove", 20), event("add", 60), event("remove", 60), event("add", 90)))
    return e.select("list", "entry", F.inline(log))
