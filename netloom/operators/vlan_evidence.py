"""Which interfaces, prefixes and devices belong to a VLAN, by several kinds of evidence.

Tables: ``vlans(id, vid, slug, sites array<string>)``, where ids that start with
``vlan:nb:`` are scoped by the slug of their site and others by platform sites;
``devices(id, slug)``, ``located(device, site)``, ``interfaces(id, device,
name)``, ``addresses(interface, subnet)``, ``prefixes(id, cidr, vid, network_id,
ipam_vid, ipam_site)`` and ``routes(device, interface, prefix)``. A device is in
a VLAN's scope if they share the slug or a platform site: both are exploded to
one key, so every kind of evidence is an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.decode import last_part
from netloom.operators.decorate import vlan_prefixes

KINDS = ("tag", "svi", "routes_to", "ipam")


def _by_site() -> Column:
    return F.startswith("id", F.lit("vlan:nb:"))


def _scoped(vlans: DataFrame) -> DataFrame:
    """(vlan, vid, scope)"""
    slug = F.when(F.col("slug") != "", F.array(F.concat(F.lit("slug:"), "slug")))
    sites = F.transform("sites", lambda s: F.concat(F.lit("site:"), s))
    return vlans.select(F.col("id").alias("vlan"), "vid", F.explode(F.when(_by_site(), slug).otherwise(sites)).alias("scope")).where("scope is not null").distinct()


def _device_scopes(devices: DataFrame, located: DataFrame) -> DataFrame:
    """(device, scope)"""
    own = devices.where("slug <> ''").select(F.col("id").alias("device"), F.concat(F.lit("slug:"), "slug").alias("scope"))
    return own.union(located.where("site is not null").select("device", F.concat(F.lit("site:"), "site"))).distinct()


def _number(name: Column, pattern: str) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), pattern, 1).try_cast("int")


def svis(vlans: DataFrame, devices: DataFrame, located: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(vlan, interface, device): interfaces named ``Vlan 5``, ``vlan5`` or ``Vl5`` on devices in scope."""
    named = interfaces.select(F.col("id").alias("interface"), "device", _number(F.col("name"), r"^(?:vlan ?|vl)(\d+)$").alias("vid")).where("vid is not null")
    return named.join(_device_scopes(devices, located), "device").join(_scoped(vlans), ["scope", "vid"]).select("vlan", "interface", "device").distinct()


def tagged(vlans: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(vlan, prefix): prefixes that carry the VLAN's number, of a network that is one of the VLAN's sites, or of none."""
    own = prefixes.where("vid is not null").select(F.col("id").alias("prefix"), "vid", "network_id")
    some = vlans.select(F.col("id").alias("vlan"), "vid", F.explode("sites").alias("site")).where("site is not null")
    keys = some.select("vlan", "vid", F.explode(F.array_distinct(F.array("site", last_part(F.col("site"))))).alias("network_id"))
    anywhere = own.where("network_id is null").drop("network_id").join(vlans.select(F.col("id").alias("vlan"), "vid"), "vid")
    return anywhere.select("vlan", "prefix").union(own.join(keys, ["vid", "network_id"]).select("vlan", "prefix")).distinct()


def by_address(found: DataFrame, addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(vlan, prefix): the subnets of the addresses on a VLAN's interfaces."""
    nets = addresses.where("subnet <> ''").select("interface", F.col("subnet").alias("cidr"))
    return found.join(nets, "interface").join(prefixes.select(F.col("id").alias("prefix"), "cidr"), "cidr").select("vlan", "prefix").distinct()


def by_route(vlans: DataFrame, devices: DataFrame, located: DataFrame, routes: DataFrame) -> DataFrame:
    """(vlan, prefix, device): routes out of an interface ``Vlan-5`` or the like of a device in scope."""
    named = routes.select("device", "prefix", _number(F.col("interface"), r"^(?:vlan-|vlan|vl)(\d+)$").alias("vid")).where("vid between 1 and 4094")
    return named.join(_device_scopes(devices, located), "device").join(_scoped(vlans), ["scope", "vid"]).select("vlan", "prefix", "device").distinct()


def by_ipam(vlans: DataFrame, devices: DataFrame, prefixes: DataFrame, routes: DataFrame) -> DataFrame:
    """(vlan, prefix, device): prefixes that address management ties to a VLAN
    number, at their own site, or without one at the site of the devices (given
    then) that route to them."""
    scoped = vlans.where(_by_site() & (F.col("slug") != "")).select(F.col("id").alias("vlan"), "vid", "slug")
    known = prefixes.where("ipam_vid is not null").select(F.col("id").alias("prefix"), F.col("ipam_vid").alias("vid"), F.nullif("ipam_site", F.lit("")).alias("slug"))
    exact = known.join(scoped, ["vid", "slug"]).select("vlan", "prefix", F.lit(None).cast(devices.schema["id"].dataType).alias("device"))
    at = routes.join(devices.where("slug <> ''").select(F.col("id").alias("device"), "slug"), "device").select("prefix", "device", "slug")
    routed = known.where("slug is null").drop("slug").join(at, "prefix").join(scoped, ["vid", "slug"]).select("vlan", "prefix", "device")
    return exact.union(routed).distinct()


def link(vlans: DataFrame, devices: DataFrame, located: DataFrame, interfaces: DataFrame, addresses: DataFrame, prefixes: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vlan, interface, device), (vlan, prefix, via_...) and (vlan, device): all
    evidence taken together. Devices are members by their interfaces, by their
    routes, and by routes to a prefix of a VLAN at their own site."""
    own = svis(vlans, devices, located, interfaces)
    route, ipam = by_route(vlans, devices, located, routes), by_ipam(vlans, devices, prefixes, routes)
    edges = vlan_prefixes(("tag", tagged(vlans, prefixes)), ("svi", by_address(own, addresses, prefixes)), ("routes_to", route), ("ipam", ipam))
    sites = vlans.where(_by_site() & (F.col("slug") != "")).select(F.col("id").alias("vlan"), "slug")
    near = edges.select("vlan", "prefix").join(sites, "vlan").join(routes.select("device", "prefix"), "prefix").join(devices.select(F.col("id").alias("device"), "slug"), ["device", "slug"])
    members = own.select("vlan", "device").union(route.select("vlan", "device")).union(ipam.where("device is not null").select("vlan", "device")).union(near.select("vlan", "device"))
    return own, edges, members.distinct()


def out_of_scope(members: DataFrame, vlans: DataFrame, devices: DataFrame) -> DataFrame:
    """The rows of ``members(vlan, device)`` whose VLAN's site is not the device's: to be removed."""
    sites = vlans.where(_by_site() & (F.col("slug") != "")).select(F.col("id").alias("vlan"), F.col("slug").alias("_v"))
    rows = members.join(sites, "vlan").join(devices.select(F.col("id").alias("device"), F.col("slug").alias("_d")), "device", "left")
    return rows.where(~F.col("_v").eqNullSafe(F.col("_d"))).select("vlan", "device")
