"""URL filters with dated lists: entries become validity intervals, and captures meet the ones active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.session import pin, prepare

FOREVER = "9999-12-31"


def host_of(url: str | Column) -> Column:
    """Lower-case host, without user, port and final dots; empty where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", "")
    return F.coalesce(F.lower(F.regexp_replace(bare, r"\.+$", "")), F.lit(""))


def entry_keys(url: str) -> Column:
    """All entries that would cover a URL: its host, every parent domain, and its host with every leading path, the root among them.

    A URL without host has none. Entries are written the same way: ``example.org``, ``a.example.org``, ``a.example.org/``,
    ``a.example.org/en/``; a leading path ends in a slash. Hosts are lower-case, paths as they are.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*/)", 1)
    parts = F.split(path, "/")
    folders = F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    root = F.array(F.concat(host, F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, root, folders)))


def intervals(events: DataFrame) -> DataFrame:
    """(list, entry, start, stop) from dated events (list, entry, action add or remove, at date); stop is exclusive.

    Events of one date count as one, removal winning; so an entry has at most one event a day, however
    often it is repeated, and its history is short. An addition lasts until the entry's next
    event. Events without list, entry, date or known action are ignored. Of an entry the host is lower-cased,
    the path is not.
    """
    host = F.substring_index("entry", "/", 1)
    entry = F.concat(F.lower(host), F.substring("entry", F.length(host) + 1, F.length("entry")))
    known = events.select("list", entry.alias("entry"), "at", (F.col("action") == "remove").alias("gone")).where(
        F.col("list").isNotNull() & (F.col("entry") != "") & F.col("at").isNotNull() & events["action"].isin("add", "remove"))
    daily = known.groupBy("list", "entry", "at").agg(F.max("gone").alias("gone"))
    following = F.lead("at").over(W.partitionBy("list", "entry").orderBy("at"))
    dated = daily.select("list", "entry", F.col("at").alias("start"), F.coalesce(following, F.lit(FOREVER).cast("date")).alias("stop"), "gone")
    return dated.where("not gone").drop("gone")


def _month(day: str | Column) -> Column:
    return (F.year(day) * 12 + F.month(day)).cast("int")


def listed_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at date, ...) with ``lists`` (sorted names of the lists that held it then) and ``blocked``.

    As-of join: distinct (url, date) pairs become one row per covering entry, intervals one row per
    month they touch within the captures' dates, and both meet on (entry, month), so a much
    captured domain is spread over its months and its short side is what the month's events
    make. Null or unusable URLs and null dates are on no list. Repeated captures stay;
    extra columns stay, those named lists or blocked are replaced.
    """
    prepare(captures.sparkSession)
    asked = pin(captures.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct())
    ends = asked.agg(F.min("fetched_at").alias("first"), F.max("fetched_at").alias("final")).first()
    periods = intervals(events)
    if ends.first is not None:
        lo, hi = F.greatest("start", F.lit(ends.first)), F.least(F.date_sub("stop", 1), F.lit(ends.final))
        periods = periods.where(lo <= hi).select(
            "list", "entry", "start", "stop", F.explode(F.sequence(_month(lo), _month(hi))).alias("month"))
    else:
        periods = periods.withColumn("month", F.lit(0)).limit(0)
    periods = pin(periods)
    # One small file of captures becomes many rows of long keys: dealt out first, to a number of tasks that is kept.
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = asked.repartition(tasks, "url", "fetched_at").select("url", "fetched_at", F.explode(entry_keys("url")).alias("entry"), _month("fetched_at").alias("month"))
    found = keyed.join(periods, ["entry", "month"]).where("fetched_at >= start and fetched_at < stop")
    found = found.groupBy("url", "fetched_at", "list").agg(F.min("entry").alias("entry"))
    lists = pin(found.groupBy("url", "fetched_at").agg(F.array_join(F.sort_array(F.collect_list("list")), ",").alias("lists")))
    kept = captures.drop("lists", "blocked")
    return kept.join(lists, ["url", "fetched_at"], "left").select(
        *[kept[c] for c in kept.columns], F.coalesce("lists", F.lit("")).alias("lists"), F.col("lists").isNotNull().alias("blocked"))
