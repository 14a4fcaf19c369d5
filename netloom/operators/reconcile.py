"""Intended against observed state: matching, differences and actions.

Actions are tables of what a writer would create; nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import adapter_rank, dashed, host_label, slug


def delta(intent_name: Column, current_name: Column, intent_serial: Column, current_serial: Column) -> Column:
    """map of field to (intent, current) where both are known and differ: names
    by their first label, serials without case."""
    name = F.when(host_label(intent_name).isNotNull() & host_label(current_name).isNotNull() & (host_label(intent_name) != host_label(current_name)), F.struct(intent_name.alias("intent"), current_name.alias("current")))
    clean = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    serial = F.when((clean(intent_serial) != clean(current_serial)), F.struct(intent_serial.alias("intent"), current_serial.alias("current")))
    return F.map_filter(F.create_map(F.lit("name"), name, F.lit("serial"), serial), lambda _, v: v.isNotNull())


def match(intent: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """``intent(key, serial, name)`` with the ``node`` of ``seen(node, serial,
    name)`` of the same serial, else of the same first label; the least of several."""
    by_serial = seen.where("serial <> ''").groupBy(F.upper("serial").alias("_s")).agg(F.min("node").alias("_by_serial"))
    by_name = seen.groupBy(host_label(F.col("name")).alias("_n")).agg(F.min("node").alias("_by_name")).where("_n is not null")
    rows = intent.join(by_serial, F.upper("serial") == F.col("_s"), "left").join(by_name, host_label(F.col("name")) == F.col("_n"), "left")
    return rows.select(*intent.columns, F.coalesce("_by_serial", "_by_name").alias("node"))


def elect(candidates: DataFrame, key: str) -> DataFrame:
    """Of several nodes for one device the most trusted source's; stubs come last."""
    rank = F.when(F.coalesce("stub", F.lit(False)), -1).otherwise(adapter_rank(F.col("source_adapter")))
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(rank), "node"))).where("_n = 1").drop("_n")


def absent(intent: DataFrame, seen: DataFrame) -> DataFrame:
    return intent.join(seen.select("id").distinct(), "id", "left_anti")


def missing_interfaces(observed: DataFrame, intended: DataFrame) -> DataFrame:
    """Observed (device, name) that the source of truth lacks, without case."""
    known = intended.select("device", F.lower("name").alias("_n")).distinct()
    rows = observed.select("device", "name").distinct().withColumn("_n", F.lower("name"))
    return rows.join(known, ["device", "_n"], "left_anti").drop("_n")


def missing_addresses(observed: DataFrame, intended: DataFrame) -> DataFrame:
    """Observed addresses whose host part the source of truth lacks."""
    host = F.split("address", "/")[0]
    return observed.withColumn("_h", host).join(intended.select(host.alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def missing_serials(matched: DataFrame) -> DataFrame:
    """Devices whose intended serial is blank and whose observed one isn't."""
    return matched.where("coalesce(trim(intent_serial), '') = '' and coalesce(trim(current_serial), '') <> ''")


def missing_cables(links: DataFrame, intended: DataFrame, protos: tuple[str, ...]) -> DataFrame:
    """Trusted links with both ports known that aren't cabled, each pair of ports once."""
    ends = lambda a, b, i, j: F.array_sort(F.array(F.concat_ws("|", a, i), F.concat_ws("|", b, j)))
    rows = links.where(F.col("proto").isin(*protos) & (F.col("interface_a") != "") & (F.col("interface_b") != "")).withColumn("_e", ends("src", "dst", F.lower("interface_a"), F.lower("interface_b")))
    cabled = intended.select(ends("src", "dst", F.lower("interface_a"), F.lower("interface_b")).alias("_e")).distinct()
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_e").orderBy("src", "dst", "interface_a"))).where("_n = 1")
    return one.join(cabled, "_e", "left_anti").drop("_e", "_n")


def network_sites(claims: DataFrame) -> DataFrame:
    """``claims(network, site)`` of networks that one site alone claims."""
    return claims.groupBy("network").agg(F.count_distinct("site").alias("n"), F.min("site").alias("site")).where("n = 1").select("network", "site")


def fill_sites(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """``nodes(network, site)`` with a missing site filled from the mapping."""
    named = mapping.select("network", F.col("site").alias("_site"))
    return nodes.join(named, "network", "left").withColumn("site", F.coalesce("site", "_site")).drop("_site")


def enrich_prefixes(prefixes: DataFrame, ipam: DataFrame) -> DataFrame:
    """``prefixes(cidr, prefix)``, either of which may name it, with vid and site of ``ipam(prefix, vid, site)``."""
    known = ipam.groupBy(F.col("prefix").alias("_p")).agg(F.min(F.struct("vid", "site")).alias("_x"))
    return prefixes.join(known, F.coalesce("cidr", "prefix") == F.col("_p"), "left").select(*prefixes.columns, F.col("_x.vid").alias("ipam_vid"), F.col("_x.site").alias("ipam_site"))


def map_sites(platform: DataFrame, sites: DataFrame, explicit: DataFrame) -> DataFrame:
    """(ps, site, method, confidence) of ``platform(ps, name)``: by the explicit
    ``(ps, site)`` table, else by slug, else by name without signs."""
    by = lambda found, method, value: found.select("ps", "site", F.lit(method).alias("method"), F.lit(value).alias("confidence"))
    first = by(explicit.join(platform, "ps", "left_semi"), "explicit", 1.0)
    left = platform.join(first, "ps", "left_anti")
    second = by(left.join(sites.select("site", F.col("slug").alias("_k")), dashed(F.col("name")) == F.col("_k")).groupBy("ps").agg(F.min("site").alias("site")), "slug", 1.0)
    left = left.join(second, "ps", "left_anti")
    third = by(left.join(sites.select("site", slug(F.col("name")).alias("_k")), slug(F.col("name")) == F.col("_k")).groupBy("ps").agg(F.min("site").alias("site")), "name", 0.9)
    return first.union(second).union(third)


def mapping_stats(mapping: DataFrame, platform: DataFrame) -> DataFrame:
    counts = mapping.groupBy("method").agg(F.count("*").alias("n"))
    return counts.union(platform.join(mapping, "ps", "left_anti").agg(F.lit("unmatched"), F.count("*")))
