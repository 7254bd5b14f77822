"""URL filters: a temporal join of captures with dated block-list entries.

An entry says that a domain pattern was added to, or removed from, a category of the list at an
instant.  Entries of one pattern and category become validity intervals (from an addition to the next
entry), and each capture is judged by the intervals open at its fetch time: interval start <= fetch
time < interval end.  A pattern covers its own host and all hosts below it.

Plan: hosts are made distinct first (partial aggregation, so a host with a third of all captures is one
row), their suffixes meet the patterns in an equi-join, and each host gets the intervals that can apply to
it; captures then join on their host.  Only that last join sees all captures: the hosts' intervals are written,
and broadcast while they are at most BROADCAST_INTERVALS (about 100 bytes each), so captures are not shuffled;
beyond that it is an ordinary equi-join whose skewed partitions Spark splits.

Defined results: a capture without a parsable host, or with a null fetch time, is allowed with no
categories; entries with a null field are ignored; at one instant a removal wins over an addition;
repeated captures each get their own row; an empty list allows everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Intervals, over all hosts, up to which they are broadcast.
BROADCAST_INTERVALS = 200_000
#: Host of a URL: scheme, optional user part, then up to the port, path, query or fragment.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def suffixes(host: Column) -> Column:
    """The host and every domain above it, longest first, down to the last label."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, since, until (null: still open) from entries (pattern, category, action 'add' or 'remove', at)."""
    known = entries.select(F.lower("pattern").alias("pattern"), "category", "action", "at").where("pattern is not null and category is not null and action in ('add', 'remove') and at is not null")
    # one row per instant: a removal wins
    at_once = known.groupBy("pattern", "category", "at").agg(F.max("action").alias("action"))
    history = Window.partitionBy("pattern", "category").orderBy("at")
    return at_once.withColumn("until", F.lead("at").over(history)).where("action = 'add'").select("pattern", "category", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Per capture row: page_id, host, fetched, categories (sorted), pattern (the longest that applied), blocked."""
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(time_col).alias("fetched"))
    hosts = rows.where("host is not null").select("host").distinct()
    reach = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("pattern"))
    applies = reach.join(intervals(entries), "pattern").groupBy("host").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "pattern", "category", "since", "until")).alias("open"))
    applies = written(applies, "url-intervals")
    small = (applies.agg(F.sum(F.size("open"))).first()[0] or 0) <= BROADCAST_INTERVALS
    joined = rows.join(F.broadcast(applies) if small else applies, "host", "left")
    active = F.filter("open", lambda x: (x["since"] <= F.col("fetched")) & (x["until"].isNull() | (F.col("fetched") < x["until"])))
    return joined.withColumn("active", F.coalesce(active, F.array())).select(
        "page_id",
        "host",
        "fetched",
        F.array_sort(F.array_distinct(F.transform("active", lambda x: x["category"]))).alias("categories"),
        F.array_max(F.transform("active", lambda x: F.struct(x["n"], x["pattern"])))["pattern"].alias("pattern"),
        (F.size("active") > 0).alias("blocked"),
    )
