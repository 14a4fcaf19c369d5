"""Filtering of captures by dated lists of domains.

Entries of a list are added and removed on dates. Each (list, domain) has
validity intervals, from an addition to the next removal. A capture is
evaluated against the entries that were active when it was fetched: its host
and the domains above it are joined to the listed domains, and an as-of join
takes for each (list, domain) the interval that began last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.asof import latest_before
from netloom.llm.web import host

BLOCK_SECONDS = 1000


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, valid_from, valid_to) of ``entries(list, domain, at, added)``.

    An entry holds up to the next one of its list and domain, whatever that is;
    consecutive additions give adjoining intervals; valid_to is null for the
    last. Of entries at one time a removal wins. Entries with nulls don't count.
    """
    known = entries.where("list is not null and domain is not null and at is not null and added is not null")
    rows = known.groupBy("list", F.lower("domain").alias("domain"), "at").agg(F.bool_and("added").alias("added"))
    following = F.lead("at").over(Window.partitionBy("list", "domain").orderBy("at"))
    return rows.select("list", "domain", F.col("at").alias("valid_from"), following.alias("valid_to"), "added").where("added").drop("added")


def evaluate(captures: DataFrame, entries: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(capture_id, host, blocked, lists, domains) of ``captures(capture_id, url, fetched_at)``.

    lists and domains name, in order, the lists that block the capture and the
    listed domains it falls under at its time; an entry is active from its
    addition on and no longer at its removal. Times are in seconds. Captures
    with a null address or time, or without a host, aren't blocked. Captures that
    repeat an id are each judged by their own host and time; other columns are
    ignored; without entries nothing is blocked; an empty table gives no rows.
    """
    rows = captures.select("capture_id", "fetched_at", F.coalesce(host(F.col("url")), F.lit("")).alias("host"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    valid = intervals(entries)
    listed = valid.select("list", "domain").distinct()
    asked = rows.where("fetched_at is not null").select("capture_id", "fetched_at", "host", F.explode(above).alias("domain")).join(listed, "domain")
    asked = asked.select("list", "domain", F.col("fetched_at").alias("at"), F.lit(1).alias("is_capture"), "capture_id", "host", F.lit(None).cast("struct<until:bigint>").alias("interval"))
    dated = valid.select("list", "domain", F.col("valid_from").cast("long").alias("at"), F.lit(0).alias("is_capture"), F.lit(None).cast("long").alias("capture_id"), F.lit(None).cast("string").alias("host"), F.struct(F.col("valid_to").cast("long").alias("until")).alias("interval"))
    last = latest_before(asked.unionByName(dated), ["list", "domain"], ["at", "is_capture", "capture_id"], F.col("interval"), F.floor(F.col("at") / block_seconds))
    active = last.where("is_capture = 1 and last is not null and (last.until is null or at < last.until)")
    hits = active.groupBy(F.col("capture_id").alias("_id"), F.col("host").alias("_host"), F.col("at").alias("_at")).agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set("domain")).alias("domains"))
    none = F.array().cast("array<string>")
    same = F.col("capture_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")) & (F.col("fetched_at") == F.col("_at"))
    return rows.join(hits, same, "left").select("capture_id", "host", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", none).alias("lists"), F.coalesce("domains", none).alias("domains"))
