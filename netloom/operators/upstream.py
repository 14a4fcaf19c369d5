"""Where devices at the network's edge get their way out from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.network import is_public_asn
from netloom.operators.paths import _cut, _steps

INTERNET = "internet:0"
#: Gates kept of a tier and site at each node: a gate is not its own way out, so its neighbours must tell of another.
KEPT = 2


def gates(devices: DataFrame, sessions: DataFrame, home_asn: int | None) -> DataFrame:
    """(id, site, name, tier): tier 1 are devices with a session to a public
    network other than the own one, ``sessions(device, remote_as)``; tier 2
    other routers and firewalls that aren't cloud-managed,
    ``devices(id, site, name, role, platform)``."""
    outside = is_public_asn(F.col("remote_as")) & ~F.coalesce(F.col("remote_as") == F.lit(home_asn), F.lit(False))
    first = sessions.where(outside).select(F.col("device").alias("id")).distinct().withColumn("tier", F.lit(1))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    second = (low("platform") != "meraki") & (low("role").isin("router", "firewall") | low("name").contains("cat8k") | low("platform").contains("c8"))
    rows = devices.select("id", "site", "name", second.alias("second")).join(first, "id", "left")
    return rows.withColumn("tier", F.coalesce("tier", F.when(F.col("second"), 2))).where("tier is not null").select("id", "site", "name", "tier")


def ways_out(edge: DataFrame, gates: DataFrame, links: DataFrame, hops: int = 6) -> DataFrame:
    """(device, upstream, tier, same_site, hops): of each of ``edge(id, site)``
    the gate that it uses, within ``hops`` of ``links(src, dst)`` and not itself:
    of the lower tier, of the own site, nearest, least by name and id. A device
    without a site takes any gate for one of its own. Without a gate upstream is
    the internet and the rest is null.

    The search goes out from all gates at once. A node keeps, for each tier, the
    nearest ``KEPT`` gates of all and of each site that has devices to serve; a
    gate of tier 2 that reaches a node later than ``KEPT`` of tier 1 is never
    chosen there or behind, and goes no further. One of tier 1 doesn't bar it:
    that one may be the device itself, which must find another gate.
    """
    steps = _steps(links)
    served = edge.select("site").where("site is not null").distinct()
    every = gates.select(F.col("id").alias("gate"), "name", "tier", F.lit(None).cast("string").alias("site"))
    own = gates.select(F.col("id").alias("gate"), "name", "tier", "site").join(served, "site", "left_semi").select("gate", "name", "tier", "site")
    seen = frontier = _cut(every.unionByName(own).select(F.col("gate").alias("node"), "tier", "site", "gate", "name", F.lit(0).alias("distance")))
    label = lambda d: d.withColumn("label", F.concat_ws("/", "tier", F.coalesce(F.concat(F.lit("s"), "site"), F.lit("*"))))
    for d in range(1, hops + 1):
        near = frontier.join(steps, frontier["node"] == steps["src"]).select(F.col("dst").alias("node"), "tier", "site", "gate", "name").distinct().withColumn("distance", F.lit(d))
        best = Window.partitionBy("node", "label").orderBy("distance", "name", "gate")
        known = label(seen)
        # what a node knows already comes first, as it was nearer
        fresh = label(near).join(known.select("node", "label", "gate"), ["node", "label", "gate"], "left_anti")
        sooner = known.where("tier = 1 and site is null").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= KEPT).select("node")
        fresh = fresh.where("tier = 1").unionByName(fresh.where("tier > 1").join(sooner, "node", "left_anti"))
        full = known.join(fresh.select("node", "label").distinct(), ["node", "label"], "left_semi").unionByName(fresh)
        frontier = _cut(full.withColumn("_k", F.row_number().over(best)).where((F.col("_k") <= KEPT) & (F.col("distance") == d)).select(*seen.columns))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    met = edge.select(F.col("id").alias("node"), F.col("site").alias("own")).join(seen.where("node <> gate"), "node")
    # a gate found under its site is one of the own site; under any site it may be
    fits = F.col("site").isNull() | F.col("site").eqNullSafe(F.col("own"))
    near_site = F.col("own").isNull() | F.col("site").isNotNull()
    order = F.struct("tier", (~near_site).alias("far"), "distance", "name", "gate")
    chosen = met.where(fits).groupBy("node").agg(F.min(order).alias("x"))
    return edge.join(chosen, edge["id"] == chosen["node"], "left").select(F.col("id").alias("device"), F.coalesce("x.gate", F.lit(INTERNET)).alias("upstream"), "x.tier", (~F.col("x.far")).alias("same_site"), F.col("x.distance").alias("hops"))


def uplinks(devices: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst, via, wan_slot, public_ip, private_ip): an uplink for each slot
    of ``devices(id, wan1_public_ip, wan2_public_ip, wan1_ip, wan2_ip)`` with a
    public address, to what ``ways_out`` found."""
    slots = F.explode(F.array(*(F.struct(F.lit(s).alias("wan_slot"), F.col(f"{s}_public_ip").alias("public_ip"), F.coalesce(F.col(f"{s}_ip"), F.lit("")).alias("private_ip")) for s in ("wan1", "wan2"))))
    rows = devices.select(F.col("id").alias("src"), slots.alias("u")).select("src", "u.*").where("public_ip <> ''")
    via = F.when(F.col("upstream") == INTERNET, "mx_uplink").otherwise("mx_upstream")
    return rows.join(found.select(F.col("device").alias("src"), "upstream"), "src").select("src", F.col("upstream").alias("dst"), via.alias("via"), "wan_slot", "public_ip", "private_ip")
