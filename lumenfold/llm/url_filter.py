"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries that add or remove a key (a host or a parent domain). Entries
become validity intervals, and every capture is judged by the entries that were active on the day
it was fetched. What decides is the host and the day, so captures are first reduced to distinct
(host, day), and those to distinct (key, day): a host or domain with a third of all captures
costs one row a day before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import materialise

#: Fixed form of the host in a URL: after the scheme and any user information, up to port or path.
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host; null for null and for text without one."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def keys_of(host: Column) -> Column:
    """The host and each parent domain of at least two labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))


def validity(entries: DataFrame) -> DataFrame:
    """(list_name, policy, key, since, until) from entries (list_name, policy, key, action, day).

    An addition holds from its day up to, not including, the day of the next removal; without one
    it holds on. On one day, removals come before additions. Repeated entries change nothing.
    Entries with a null key, day or action are left out.
    """
    rows = entries.select("list_name", "policy", F.lower("key").alias("key"), "action", "day").where("key is not null and day is not null and action in ('add', 'remove')").distinct()
    later = Window.partitionBy("list_name", "policy", "key").orderBy("day", F.when(F.col("action") == "remove", 0).otherwise(1)).rowsBetween(1, Window.unboundedFollowing)
    until = F.min(F.when(F.col("action") == "remove", F.col("day"))).over(later)
    return rows.withColumn("until", until).where("action = 'add'").select("list_name", "policy", "key", F.col("day").alias("since"), "until")


def active_on(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, _day, list_name, policy) of the entries that are active, by an as-of join: for each key and list, the last interval that began by the day, if it hasn't ended.

    Days and intervals of a key and list lie in one order, so a list with many dated entries costs a row each, not one for each day.
    """
    lists = spans.select("key", "list_name", "policy").distinct()
    days = asked.join(lists, "key").select("key", "list_name", "policy", "_day", F.lit(1).alias("asks"), F.lit(None).cast("struct<until:date>").alias("span"))
    begin = spans.select("key", "list_name", "policy", F.col("since").alias("_day"), F.lit(0).alias("asks"), F.struct("until").alias("span"))
    so_far = Window.partitionBy("key", "list_name", "policy").orderBy("_day", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = days.unionByName(begin).withColumn("span", F.last("span", ignorenulls=True).over(so_far)).where("asks = 1 and span is not null")
    return met.where("span.until is null or _day < span.until").select("key", "_day", "list_name", "policy")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """One row per capture: id, host, day, blocked, list_name and entry_key of the entry that decides.

    The entry with the longest key decides; of several, one that blocks, then the first list by
    name. A capture without a host, a day or an active entry isn't blocked and has no entry.
    Entries name hosts and domains; a host that is an IPv6 address keeps its brackets.
    Repeated captures are judged each. Only the named columns are read.
    """
    seen = captures.select(F.col(f"`{id_col}`").alias("_id"), host_of(F.col(f"`{url_col}`").cast("string")).alias("_host"), F.col(f"`{day_col}`").cast("date").alias("_day"))
    hosts = seen.where("_host is not null and _day is not null").select("_host", "_day").distinct()
    keyed = hosts.select("_host", "_day", F.explode(keys_of(F.col("_host"))).alias("key"))
    best = F.min(F.struct(F.when(F.col("policy") == "block", 0).otherwise(1).alias("weak"), "list_name"))
    active = active_on(keyed.select("key", "_day").distinct(), validity(entries)).groupBy("key", "_day").agg(best.alias("entry"))
    decided = keyed.join(active, ["key", "_day"]).groupBy("_host", "_day").agg(F.min(F.struct((-F.length("key")).alias("short"), "key", "entry")).alias("won"))
    # Written, so that the join may split the captures of one host and day; those without a host get keys that no host has and spread.
    decided, _ = materialise(decided, "url-decisions")
    nowhere = F.concat(F.lit("/"), F.pmod(F.xxhash64("_id"), F.lit(4096)).cast("string"))
    return (
        seen.withColumn("_at", F.coalesce("_host", nowhere))
        .join(decided.withColumnRenamed("_host", "_at"), ["_at", "_day"], "left")
        .select(
            F.col("_id").alias(id_col),
            F.col("_host").alias("host"),
            F.col("_day").alias("day"),
            F.coalesce(F.col("won.entry.weak") == 0, F.lit(False)).alias("blocked"),
            F.col("won.entry.list_name").alias("list_name"),
            F.col("won.key").alias("entry_key"),
        )
    )
