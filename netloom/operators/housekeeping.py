"""Periodic clean-up of the graph, as filters and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.names import pick
from netloom.operators.paths import _cut, _dealt

#: Types whose nodes go when nothing is attached to them.
LOOSE = ("RoutingPeer", "MACAddress", "ARPEntry", "IPAddress", "Prefix")

#: What must hold a node of a type for it to stay.
NEEDS = {"Interface": ("HAS_INTERFACE",), "IPAddress": ("ASSIGNED_IP",), "ARPEntry": ("HAS_ARP",), "MACAddress": ("OWNS_MAC", "LEARNED_MAC"), "Prefix": ("HAS_PREFIX", "ROUTES_TO"), "VRF": ("VRF_MEMBER",)}


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stubs and loose nodes of ``nodes(id, type, stub)`` without any edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.where(F.coalesce("stub", F.lit(False)) | F.col("type").isin(*LOOSE)).join(ends, "id", "left_anti")


def malformed(nodes: DataFrame) -> DataFrame:
    """Canonical VLANs without a platform site, interfaces of devices known by
    their address only, and ``port-N`` interfaces."""
    vlan = (F.col("type") == "VLAN") & F.col("id").startswith("vlan:") & F.col("platform_site_id").isNull()
    port = (F.col("type") == "Interface") & (F.col("id").rlike(r"^snmp-if:\d+\.\d+\.\d+\.\d+:") | F.lower("name").rlike(r"^port-\d+$"))
    return nodes.where(vlan | port)


def swept(nodes: DataFrame, edges: DataFrame, needs: dict[str, tuple[str, ...]] = NEEDS) -> tuple[DataFrame, DataFrame]:
    """``nodes(id, type)`` and ``edges(src, dst, type)`` without nodes that
    nothing holds, again and again until every node left is held: with a device
    go its interfaces, with them their addresses. Each round looks only at what
    the nodes that went in the last one held. Nodes that hold each other stay.
    Edges of nodes that aren't there, or go, go too."""
    held_by = [(F.col("kind") == k) & F.col("type").isin(*v) for k, v in needs.items()]
    holds = held_by[0]
    for h in held_by[1:]:
        holds = holds | h
    kinds = nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind"))
    here = nodes.select(F.col("id").alias("src")).distinct()
    tied = edges.where(F.col("type").isin(*{x for v in needs.values() for x in v})).select("src", "dst", "type").join(kinds, "dst").where(holds)
    held = _dealt(tied.select("src", "dst").join(here, "src", "left_semi"), "src")
    holders = _dealt(held.groupBy("dst").agg(F.count("*").alias("n")), "dst")
    gone = _cut(nodes.where(F.col("type").isin(*needs)).select("id").distinct().join(holders.select(F.col("dst").alias("id")), "id", "left_anti"))
    every, lost = gone, None
    while not gone.isEmpty():
        # what went holds nothing any more: each edge is lost once, and a node goes with its last
        fresh = _cut(held.join(gone.select(F.col("id").alias("src")), "src").groupBy("dst").agg(F.count("*").alias("n")))
        lost = fresh if lost is None else lost.union(fresh)
        taken = lost.join(fresh.select("dst"), "dst", "left_semi").groupBy("dst").agg(F.sum("n").alias("taken"))
        gone = _cut(holders.join(taken, "dst").where("taken = n").select(F.col("dst").alias("id")).join(every, "id", "left_anti"))
        every = every.union(gone)
    kept = nodes.join(every, "id", "left_anti")
    ids = kept.select("id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return kept, edges


def without_reversed(links: DataFrame) -> DataFrame:
    """``links`` without those that repeat a link of the other direction over the same two ports."""
    ports = F.array_sort(F.array(F.coalesce("interface_a", F.lit("")), F.coalesce("interface_b", F.lit(""))))
    keyed = links.withColumn("_p", ports)
    forward = keyed.where("src < dst").select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.col("_p").alias("_q")).distinct()
    return keyed.join(forward, (F.col("src") == F.col("_b")) & (F.col("dst") == F.col("_a")) & (F.col("_p") == F.col("_q")), "left_anti").drop("_p")


def management_ip(sdwan: Column, vlan_ip: Column, vpn_ip: Column, wan1: Column, wan2: Column, candidates: Column) -> Column:
    """One rule for gateways (own VLAN address, then VPN, then WAN) and others (first candidate)."""
    gateway = F.when(sdwan, pick(vlan_ip, vpn_ip, wan1, wan2)).otherwise(pick(wan1, wan2))
    return F.coalesce(gateway, F.try_element_at(candidates, F.lit(1)))


def vlan_counts(members: DataFrame) -> DataFrame:
    """VLANs of each device over its name variants."""
    rows = members.groupBy(F.lower("device_name").alias("device")).agg(F.array_distinct(F.flatten(F.collect_list("vlans"))).alias("vlans"))
    return rows.select("device", F.size("vlans").alias("vlan_count"))


def freshness(rows: DataFrame, now_ms: int) -> DataFrame:
    """Missing times filled: first_seen from last_seen, changed_at from first_seen."""
    first = F.coalesce("first_seen", "last_seen", F.lit(now_ms))
    return rows.withColumns({"first_seen": first, "last_seen": F.coalesce("last_seen", F.lit(now_ms)), "changed_at": F.coalesce("changed_at", first)})


def coverage_marks(devices: DataFrame, cloud: DataFrame) -> DataFrame:
    """Devices that a cloud poll of ``cloud(serial, mac, name)`` covers by any of the three."""
    keys = lambda d: d.select(*(["id"] if "id" in d.columns else []), F.explode(F.array(F.concat(F.lit("s:"), F.upper("serial")), F.concat(F.lit("m:"), F.lower("mac")), F.concat(F.lit("n:"), F.lower("name")))).alias("k")).where("k is not null")
    covered = keys(devices).join(keys(cloud).select("k").distinct(), "k", "left_semi").select("id").distinct()
    return devices.join(covered.withColumn("cloud_covered", F.lit(True)), "id", "left").na.fill({"cloud_covered": False})
