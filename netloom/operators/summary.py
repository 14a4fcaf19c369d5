"""Summaries of the graph, one device with all that is known of it, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.names import host_label, normalize_ifname

#: Edge types of the lists of links.
LISTED = ("PHYSICAL_LINK", "ROUTING_PEER", "WAN_UPLINK", "VXLAN_TUNNEL")


def roles(devices: DataFrame) -> DataFrame:
    return devices.groupBy("role").agg(F.count("*").alias("n"))


def poll_coverage(devices: DataFrame) -> DataFrame:
    """(adapter, ok, total) of ``devices(source_adapter, snmp_polled)``; blank adapters don't count."""
    known = devices.where("source_adapter <> ''")
    return known.groupBy(F.col("source_adapter").alias("adapter")).agg(F.count_if("snmp_polled").alias("ok"), F.count("*").alias("total"))


def graph_summary(nodes: DataFrame, edges: DataFrame, devices: DataFrame, sites: DataFrame, most_sites: int = 20) -> DataFrame:
    """(section, name, n): nodes and edges by type, devices by role, and the first sites by name."""
    by = lambda rows, section, column: rows.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    first = sites.orderBy("name").limit(most_sites).select(F.lit("site"), "name", F.lit(None).cast("bigint"))
    return by(nodes, "node", "type").union(by(edges, "edge", "type")).union(by(devices, "role", "role")).union(first)


def status_document(adapters: DataFrame, devices: DataFrame) -> DataFrame:
    """``adapters(adapter, state)`` with the coverage of their devices, null where they have none."""
    return adapters.join(poll_coverage(devices), "adapter", "left").select("adapter", "state", "ok", "total")


def dominant_slug(devices: DataFrame) -> DataFrame:
    """(platform_site, slug): of each platform site its devices' most frequent slug, of equals the least."""
    counts = devices.where("slug <> ''").groupBy("platform_site", "slug").agg(F.count("*").alias("n"))
    return counts.groupBy("platform_site").agg(F.min_by("slug", F.struct(-F.col("n"), F.col("slug"))).alias("slug"))


def domain_peers(devices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, peers, size) of ``devices(id, domain)``: linked devices of the same domain, and its size."""
    own = devices.where("domain is not null").select("id", "domain")
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    near = both.join(own.withColumnsRenamed({"id": "src", "domain": "_a"}), "src").join(own.withColumnsRenamed({"id": "dst", "domain": "_b"}), "dst").where("_a = _b")
    peers = near.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("peers"))
    sizes = own.groupBy("domain").agg(F.count_distinct("id").alias("size"))
    return own.join(peers, "id", "left").join(sizes, "domain").select("id", F.coalesce("peers", F.lit(0)).alias("peers"), "size")


def envelope(rows: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first ``limit`` rows (1 to 500) in order, each with returned, total, limit and truncated."""
    limit = max(1, min(500, limit))
    total = rows.agg(F.count("*").alias("total"))
    few = rows.orderBy(*order).limit(limit)
    return few.join(F.broadcast(total)).withColumns({"limit": F.lit(limit), "returned": F.least("total", F.lit(limit)), "truncated": F.col("total") > limit})


def listed_links(edges: DataFrame, devices: DataFrame) -> DataFrame:
    """Edges of the four listed types with their ends' names."""
    name = lambda end: devices.select(F.col("id").alias(end), F.coalesce("name", "id").alias(f"{end}_name"))
    return edges.where(F.col("type").isin(*LISTED)).join(name("src"), "src").join(name("dst"), "dst")


def tunnel_mesh(devices: DataFrame) -> DataFrame:
    """(src, dst, fabric): the pairs of a fabric's ``devices(id, fabric)``, lower id first. Fabrics
    have a few hundred tunnel ends; this is their mesh itself, not a way to a smaller result."""
    other = devices.select(F.col("id").alias("dst"), "fabric")
    return devices.select(F.col("id").alias("src"), "fabric").join(other, "fabric").where("src < dst").select("src", "dst", "fabric")


def by_canonical_id(devices: DataFrame) -> DataFrame:
    """(stub, canonical): neighbour stubs that name a real device."""
    stub = F.col("id").rlike("^(lldp|cdp)-neighbor:")
    named = devices.where(stub & (F.col("canonical_id") != "") & (F.col("canonical_id") != F.col("id"))).select(F.col("id").alias("stub"), F.col("canonical_id").alias("canonical"))
    return named.join(devices.where(~stub).select(F.col("id").alias("canonical")).distinct(), "canonical", "left_semi").select("stub", "canonical")


def canonical_names(interfaces: DataFrame) -> DataFrame:
    """Interfaces whose canonical name is blank get it from their name."""
    blank = F.coalesce("name_canonical", F.lit("")) == ""
    return interfaces.withColumn("name_canonical", F.when(blank & F.col("name").isNotNull(), F.nullif(normalize_ifname(F.col("name")), F.lit(""))).otherwise(F.col("name_canonical")))


def site_mismatches(devices: DataFrame, limit: int = 500) -> DataFrame:
    """Devices known to the source of truth whose stored difference isn't empty, with it as a map."""
    rows = devices.where("netbox_id is not null and canonical_id is null and netbox_delta <> ''")
    delta = F.coalesce(F.from_json("netbox_delta", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.orderBy("id").limit(limit).select(F.coalesce("display_name", "name").alias("device"), "netbox_id", delta.alias("delta"), F.col("netbox_site_slug").alias("observed_site"))


def absent_report(devices: DataFrame, located: DataFrame, limit: int = 500) -> DataFrame:
    """Devices marked as absent from the source of truth, with their platform site."""
    mark = F.get_json_object("netbox_delta", "$.type") == "absent_in_netbox"
    site = located.groupBy("id").agg(F.min("site").alias("platform_site"))
    rows = devices.where(mark & F.col("canonical_id").isNull() & ~F.coalesce("stub", F.lit(False))).orderBy("id").limit(limit)
    return rows.join(site, "id", "left").select("id", F.coalesce("display_name", "name").alias("device"), "platform_site")


def located_under(placed: DataFrame, site: str, hops: int = 3) -> DataFrame:
    """(id) of what ``placed(id, parent)`` puts under a site within ``hops``."""
    found = level = placed.where(F.col("parent") == site).select("id").distinct()
    for _ in range(hops - 1):
        level = placed.join(level.select(F.col("id").alias("parent")), "parent", "left_semi").select("id").distinct()
        found = found.union(level)
    return found.distinct()


def explore(devices: DataFrame, key: str, sections: dict[str, tuple[DataFrame, str]], names: DataFrame | None = None) -> DataFrame:
    """(device, section, item): all that several tables know of one device.

    The device is the one of that id, else of that name or first label, no stub
    before stubs, then the least id. ``sections`` maps a section's name to a
    table and the column that names its device. item is the row as JSON. Each
    table is filtered by the one device before anything else.
    """
    low = F.lit(key.lower())
    fits = (F.col("id") == key) | (F.lower("name") == low) | (host_label(F.col("name")) == low)
    one = devices.where(fits).orderBy(F.when(F.col("id") == key, 0).otherwise(1), F.coalesce("stub", F.lit(False)), "id").limit(1)
    out = one.select(F.col("id").alias("device"), F.lit("device").alias("section"), F.to_json(F.struct(*devices.columns)).alias("item"))
    me = F.broadcast(one.select(F.col("id").alias("_me")))  # a single row
    for section, (table, column) in sections.items():
        rows = table.join(me, F.col(column) == F.col("_me"))
        out = out.union(rows.select(F.col("_me"), F.lit(section), F.to_json(F.struct(*(c for c in table.columns if c != column)))))
    return out


def explorer_counts(found: DataFrame) -> DataFrame:
    """(device, section, n) of ``explore``."""
    return found.where("section <> 'device'").groupBy("device", "section").agg(F.count("*").alias("n"))


def locate_address(prefixes: DataFrame, addresses: DataFrame, routes: DataFrame, links: DataFrame, text: str, most: int = 20) -> DataFrame:
    """(kind, device, interface, value): of a prefix the devices that route to it
    and the links that carry it, of an address its interfaces and the routes out of it."""
    row = lambda rows, kind, device, interface, value: rows.select(F.lit(kind).alias("kind"), F.col(device).alias("device"), F.col(interface).alias("interface"), F.col(value).alias("value"))
    if "/" in text:
        known = prefixes.where(F.coalesce("cidr", "prefix") == text).select("prefix_id")
        attached = routes.join(known, "prefix_id", "left_semi").withColumn("_v", F.lit(text))
        carrying = links.where(F.array_contains("prefixes", text)).orderBy("src", "dst", "interface_a").limit(50).withColumn("_v", F.lit(text))
        return row(attached, "prefix", "device", "interface", "_v").union(row(carrying, "link", "src", "interface_a", "_v"))
    first = lambda rows: rows.where(F.col("ip") == text).orderBy("device", "interface").limit(most)
    return row(first(addresses), "address", "device", "interface", "ip").union(row(first(routes), "route", "device", "interface", "ip"))

