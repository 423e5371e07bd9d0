"""Temporal URL filters: every capture is judged by the list entries that were active when it was fetched.

A dated list is a table of events: on some date a pattern is added to a list or removed from it.
The events of a pattern become validity intervals [valid_from, valid_to), open at the end while it has
not been removed.  A capture's URL gives the keys that patterns can name: its host, each domain that
the host lies in, and each of its path prefixes.  The as-of join is an equi-join on the key plus the
interval condition; intervals of a pattern do not overlap, so a key meets at most one interval of a
list.

Very common keys (a domain with a third of all captures, all of one crawl's days) are salted: an interval
is repeated `SALT` times, and captures join on key and salt.  Intervals are broadcast only where they are few.
The lengths of listed domains and prefixes, of which there are no more than a pattern has characters, are collected.
Everything is DataFrame functions.

Null or empty URLs have no keys and match nothing; a null fetch time matches nothing.  Events
without a pattern, list or date are ignored; of several on one date a removal counts.  Captures
that repeat are judged alike, each row for itself.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.graph import saved

#: Interval rows that are broadcast; more are joined by shuffle.
FEW_INTERVALS = 200_000
#: Ways in which captures of one key are split beyond that.
SALT = 32
KINDS = ("host", "domain", "prefix")


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from events (list, kind, pattern, added boolean, at timestamp_ntz)."""
    good = events.where("list is not null and kind is not null and pattern is not null and pattern <> '' and at is not null and added is not null")
    good = good.withColumn("pattern", F.lower("pattern"))
    day = good.groupBy("list", "kind", "pattern", "at").agg(F.min("added").alias("added"))
    by = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    # Successive additions are one interval: only changes of state count.
    change = day.withColumn("before", F.lag("added").over(by)).where("before is null or before <> added")
    return change.withColumn("valid_to", F.lead("at").over(by)).where("added").select("list", "kind", "pattern", F.col("at").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def keys(url: Column, domains: list[int], prefixes: list[int]) -> Column:
    """array<struct<kind, key>>: the host, the domains that it lies in, and host plus path up to each slash.

    Only domains and prefixes of the lengths given, those of the listed patterns, so that a URL of any length has
    few keys and no list of all its prefixes is built.
    """
    name = host(url)
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1))
    whole, dotted = F.concat(name, path), F.concat(F.lit("."), name)

    def lengths(some: list[int]) -> Column:
        return F.array(*[F.lit(n) for n in some]).cast("array<int>")

    # A domain begins the host or follows a dot of it; a prefix ends with a slash or is all there is.
    found_domains = F.transform(F.filter(lengths(domains), lambda n: (n <= F.length(name)) & (dotted.substr(F.length(name) - n + 1, F.lit(1)) == ".")), lambda n: name.substr(F.length(name) - n + 1, n))
    found_prefixes = F.transform(F.filter(lengths(prefixes), lambda n: (n == F.length(whole)) | (whole.substr(n, F.lit(1)) == "/")), lambda n: whole.substr(F.lit(1), n))

    def as_kind(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    some = F.concat(as_kind("host", F.array(name)), as_kind("domain", found_domains), as_kind("prefix", found_prefixes))
    return F.when(name != "", some).otherwise(F.slice(some, 1, 0))


def judge(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """One row per capture: id, url, time, n_active (active entries that it meets), blocked, matched (their list:kind:pattern, sorted)."""
    valid = saved(intervals(events), "intervals")
    sizes = valid.where("kind in ('domain', 'prefix')").select("kind", F.length("pattern").alias("n")).distinct().collect()
    domains, prefixes = (sorted(r.n for r in sizes if r.kind == kind) for kind in ("domain", "prefix"))
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("at"))
    seen = rows.where("url is not null and at is not null").select("url", "at").distinct()
    asked = seen.select("url", "at", F.explode(keys(F.col("url"), domains, prefixes)).alias("k")).select("url", "at", "k.kind", F.col("k.key").alias("pattern"))
    if valid.count() <= FEW_INTERVALS:
        met = asked.join(F.broadcast(valid), ["kind", "pattern"])
    else:
        salted = valid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("url", "at"), F.lit(SALT)).cast("int")).join(salted, ["kind", "pattern", "salt"])
    met = met.where("valid_from <= at and (valid_to is null or at < valid_to)")
    found = met.groupBy("url", "at").agg(
        F.count("*").alias("n_active"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "list", "kind", "pattern"))), " ").alias("matched")
    )
    out = rows.join(found, ["url", "at"], "left")
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return out.select("id", "url", "at", n.alias("n_active"), (n > 0).alias("blocked"), F.coalesce("matched", F.lit("")).alias("matched"))
