"""Read operators: inventories, topologies, lookups and the ranked problem report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.health import DOWN, staleness
from netloom.functions.names import host_label, mac
from netloom.operators.summary import located_under, locate_address

# fixed values: edge types of the overlays, and of the older dimensions
OVERLAYS = {
    "physical": ("PHYSICAL_LINK", "HAS_INTERFACE"),
    "l2": ("PHYSICAL_LINK", "LOGICAL_MEMBER", "HAS_SVI", "STP_MEMBER", "STP_ROOT", "STP_LINK"),
    "l3": ("PHYSICAL_LINK", "ROUTES_TO", "BGP_PEER", "VRF_MEMBER", "ROUTING_PEER", "ASSIGNED_IP"),
    "sdwan": ("SDWAN_TUNNEL", "POLICY_APPLIES"),
    "fabric": ("VNI_EXTENDS", "FABRIC_PEER", "VNI_MEMBER"),
    "virtual": ("HAS_VM", "VM_NETWORK"),
    "wan": ("WAN_UPLINK", "TRANSITS"),
}
DIMENSIONS = {
    "physical": OVERLAYS["physical"],
    "logical": ("LOGICAL_MEMBER", "HAS_SVI", "ASSIGNED_IP", "VRF_MEMBER"),
    "routing": OVERLAYS["l3"],
    "fabric": OVERLAYS["fabric"],
    "sdwan": OVERLAYS["sdwan"],
    "virtual": ("HAS_VM", "VM_NETWORK", "LOGICAL_MEMBER", "HAS_SVI", "VNI_MEMBER"),
    "stp": ("STP_MEMBER", "STP_ROOT", "STP_LINK"),
    "wan": OVERLAYS["wan"],
}
HIDDEN = ("Interface", "MACAddress", "ARPEntry", "STPDomain", "Site", "Location")
SEVERITIES = ("critical", "warning", "info")


def overlay_types(*overlays: str, dimension: str | None = None) -> list[str]:
    """Edge types of the union of overlays; without any, of a dimension."""
    return sorted({t for o in overlays for t in OVERLAYS[o]} if overlays else DIMENSIONS.get(dimension, ()))


def counts_by_type(rows: DataFrame, types: list[str]) -> DataFrame:
    """Rows of each type, zeros too."""
    known = rows.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return known.join(rows.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def provenance(links: DataFrame) -> DataFrame:
    return links.groupBy(F.coalesce("proto", "source", F.lit("unknown")).alias("origin")).agg(F.count("*").alias("n"))


def full_graph(nodes: DataFrame, edges: DataFrame, overlays: list[str], site: str | None = None, placed: DataFrame | None = None, limit: int = 2000, dimension: str | None = None, hidden: tuple[str, ...] = HIDDEN) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of some overlays, or of a dimension: without hidden types,
    merged stubs and absorbed prefixes, at most ``limit`` edges in the order of
    their keys. With ``site`` an edge's source must be of the site, or lie under
    it within three steps of ``placed(id, parent)``. Physical links among the
    shown nodes always come along."""
    shown = nodes.where(~F.col("type").isin(*hidden) & F.col("canonical_id").isNull() & F.col("absorbed_by").isNull())
    ids = shown.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if site is not None:
        local = nodes.where(F.col("site") == site).select("id")
        local = local if placed is None else local.union(located_under(placed, site)).distinct()
        inside = inside.join(local.withColumnRenamed("id", "src"), "src", "left_semi")
    key = ["type", "src", "dst", *(c for c in ("interface_a", "interface_b", "rid") if c in edges.columns)]
    main = inside.where(F.col("type").isin(*overlay_types(*overlays, dimension=dimension))).orderBy(*key).limit(limit)
    spine = inside.where(F.col("type") == "PHYSICAL_LINK")
    kept = main.union(spine.select(*main.columns)).distinct()
    ends = kept.select(F.col("src").alias("id")).union(kept.select("dst")).distinct()
    return shown.join(ends, "id", "left_semi"), kept


def collapse_l3(edges: DataFrame) -> DataFrame:
    """Routing edges between ends that a physical link joins give way to it."""
    pair = [F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")]
    cabled = edges.where("type = 'PHYSICAL_LINK'").select(*pair).distinct()
    rows = edges.select("*", *pair)
    kept = rows.join(cabled, ["_a", "_b"], "left_anti").union(rows.where("type = 'PHYSICAL_LINK'").select("_a", "_b", *edges.columns))
    return kept.drop("_a", "_b").distinct()


def capped(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` nodes by id, and the edges among them."""
    few = nodes.orderBy("id").limit(most)
    ids = few.select("id")
    return few, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def aggregated(devices: DataFrame, links: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """Devices by ``level`` (a column) with counts and up to ten names, and the
    links between different groups."""
    groups = devices.groupBy(level).agg(F.count("*").alias("devices"), F.count_if(F.lower("status").isin(*DOWN)).alias("down"))
    # ranked, so that a large group's names are cut where they lie and not gathered
    first = Window.partitionBy(level).orderBy("name")
    names = devices.where("name is not null").select(level, "name").distinct().withColumn("_k", F.row_number().over(first)).where("_k <= 10")
    sample = names.groupBy(F.col(level).alias("_level")).agg(F.sort_array(F.collect_list("name")).alias("sample"))
    groups = groups.join(sample, F.col(level).eqNullSafe(F.col("_level")), "left").drop("_level").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
    of = devices.select("id", level)
    ends = links.join(of.withColumnsRenamed({"id": "src", level: "a"}), "src").join(of.withColumnsRenamed({"id": "dst", level: "b"}), "dst").where("a <> b")
    return groups, ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("links"))


def correlated_cam(learned: DataFrame, owned: DataFrame, bindings: DataFrame) -> DataFrame:
    """(mac, port, owner, ips, source) of addresses that are learned, owned or
    bound: where they were last learned, who owns them and their addresses."""
    port = learned.groupBy("mac").agg(F.min(F.struct("device", "interface")).alias("port"))
    owner = owned.groupBy("mac").agg(F.min("device").alias("owner"))
    ips = bindings.groupBy("mac").agg(F.sort_array(F.collect_set("ip")).alias("ips"))
    rows = port.join(owner, "mac", "full_outer").join(ips, "mac", "full_outer")
    source = F.when(F.col("port").isNotNull(), "learned").when(F.col("owner").isNotNull(), "owned").otherwise("arp")
    return rows.select("mac", F.col("port.device").alias("switch"), F.col("port.interface").alias("interface"), "owner", "ips", source.alias("source"))


def mac_lookup(learned: DataFrame, owned: DataFrame, bindings: DataFrame, address: str, limit: int = 50) -> DataFrame:
    """``correlated_cam`` of one address; the filter comes before the joins."""
    want = lambda d: d.where(mac(F.col("mac")) == mac(F.lit(address)))
    return correlated_cam(want(learned), want(owned), want(bindings)).orderBy("mac").limit(limit)


ip_lookup = locate_address


def mac_table(learned: DataFrame, device: str | None = None, address: str | None = None, limit: int = 500) -> DataFrame:
    rows = learned if device is None else learned.where(F.col("device") == device)
    rows = rows if address is None else rows.where(mac(F.col("mac")) == mac(F.lit(address)))
    return rows.orderBy("device", "interface", "mac").limit(limit)


def vlan_inventory(members: DataFrame, site: str | None = None, device: str | None = None) -> DataFrame:
    """VLANs with their devices and sites; filters look at the aggregated lists."""
    rows = members.groupBy("vid").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("device")).alias("devices"), F.sort_array(F.collect_set("site")).alias("sites"))
    rows = rows if site is None else rows.where(F.exists("sites", lambda s: F.contains(F.lower(s), F.lit(site.lower()))))
    return rows if device is None else rows.where(F.exists("devices", lambda d: F.contains(F.lower(d), F.lit(device.lower()))))


def vlan_members(members: DataFrame, vid: int) -> DataFrame:
    return members.where(F.col("vid") == vid).select("device", "vid").distinct()


def stp_document(members: DataFrame, ports: DataFrame) -> DataFrame:
    """Each domain with its members and their ports, sorted."""
    own = ports.groupBy("domain", "device").agg(F.array_sort(F.collect_list(F.struct("interface", "state", "role"))).alias("ports"))
    rows = members.join(own, ["domain", "device"], "left").select("domain", F.struct("device", "is_root", "ports").alias("m"))
    return rows.groupBy("domain").agg(F.array_sort(F.collect_list("m")).alias("members"))


def routing_topology(routes: DataFrame) -> DataFrame:
    return routes.groupBy("prefix").agg(F.sort_array(F.collect_set("device")).alias("devices"), F.count_distinct("device").alias("n"))


def filter_catalog(sites: DataFrame, devices: DataFrame) -> DataFrame:
    """Sites, also those that only devices name, and devices once for each name."""
    every = sites.select("slug").union(devices.where("site_slug <> ''").select("site_slug")).distinct().select(F.lit("site").alias("kind"), F.col("slug").alias("value"))
    one = Window.partitionBy(F.lower("name")).orderBy("id")
    named = devices.where("name <> ''").withColumn("_n", F.row_number().over(one)).where("_n = 1").select(F.lit("device").alias("kind"), F.col("name").alias("value"))
    return every.union(named)


def inventory(devices: DataFrame, located: DataFrame) -> DataFrame:
    """Devices that aren't stubs, with one site, their sources and the state of their polling."""
    site = located.groupBy("id").agg(F.min("site").alias("site"))
    health = F.when(F.col("snmp_health").isNotNull(), F.col("snmp_health")).when(F.col("snmp_polled"), "full").when(F.col("mgmt_ip").isNull(), "cloud_only").otherwise("unpolled")
    sources = F.array_sort(F.array_distinct(F.filter(F.array("source_adapter", F.when(F.col("snmp_polled"), "snmp")), lambda x: x.isNotNull())))
    return devices.where(~F.coalesce("stub", F.lit(False))).join(site, "id", "left").withColumns({"snmp_health": health, "data_sources": sources})


def inventory_list(rows: DataFrame, site: str | None = None, role: str | None = None, status: str | None = None, flap: str | None = None, limit: int = 100) -> DataFrame:
    for column, value in (("site", site), ("role", role), ("status", status), ("flap_state", flap)):
        if value is not None:
            rows = rows.where(F.lower(column) == value.lower())
    return rows.orderBy("name", "id").limit(max(1, min(500, limit)))


def breaches(links: DataFrame) -> DataFrame:
    """Links with the bounds that their use (75, 85, 95 %) and errors (1, 5 a second) pass."""
    over = lambda c, bounds: F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col(c) >= b)
    return links.withColumns({"util_breaches": over("util_avg_1h", (75, 85, 95)), "error_breaches": over("error_avg_1h", (1, 5))})


def peers(edges: DataFrame, state: str | None = None) -> DataFrame:
    """Sessions once each, whichever direction they are stored in."""
    key = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    rows = edges.select(*key, "protocol", "state", "flap_state").groupBy("a", "b", "protocol").agg(F.max("state").alias("state"), F.max("flap_state").alias("flap_state"))
    return rows if state is None else rows.where(F.col("state") == state)


def device_context(devices: DataFrame, interfaces: DataFrame, name: str) -> DataFrame:
    """The best device of a name: no stub, most interfaces, then the least id."""
    n = interfaces.groupBy(F.col("device").alias("id")).agg(F.count("*").alias("n_interfaces"))
    rows = devices.where((F.col("id") == name) | (host_label(F.col("name")) == host_label(F.lit(name)))).join(n, "id", "left")
    return rows.orderBy(F.coalesce("stub", F.lit(False)), F.desc_nulls_last("n_interfaces"), "id").limit(1)


def history_of(element: str, *tables: DataFrame) -> DataFrame:
    """History of the first of several (element, at, state) tables that knows the element."""
    rows = None
    for k, t in enumerate(tables):
        part = t.where(F.col("element") == element).select("element", "at", "state", F.lit(k).alias("_k"))
        rows = part if rows is None else rows.union(part)
    return rows.withColumn("_m", F.min("_k").over(Window.partitionBy("element"))).where("_k = _m").drop("_k", "_m")


def match_profiles(devices: DataFrame, rules: DataFrame) -> DataFrame:
    """The first of ``rules(ordinal, profile, oid_prefix, name_regex, model_glob,
    adapter)`` that fits each device; all criteria of a rule must, null ones do.
    The rules are a small table of their own, sent to every executor."""
    glob = F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.col("model_glob"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    fits = lambda rule, ok: F.col(rule).isNull() | F.coalesce(ok, F.lit(False))
    every = fits("oid_prefix", F.startswith("sys_object_id", F.col("oid_prefix"))) & fits("name_regex", F.regexp_like("name", F.col("name_regex"))) & fits("model_glob", F.regexp_like("model", glob)) & fits("adapter", F.startswith("source_adapter", F.col("adapter")))
    best = devices.join(F.broadcast(rules), every).groupBy("id").agg(F.min_by("profile", "ordinal").alias("profile"))
    return devices.join(best, "id", "left").withColumn("profile", F.coalesce("profile", F.lit("default")))


def _problem(rows: DataFrame, kind: str, severity: Column | str, summary: Column, element: str = "id") -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(kind).alias("problem_type"), severity.alias("severity"), summary.alias("summary"), F.col(element).cast("string").alias("element"))


def problems(devices: DataFrame, links: DataFrame, sessions: DataFrame, now_ms: int, threshold_s: int = 86400, stale: str = "info", limit: int | None = None, severity: str | None = None) -> DataFrame:
    """Ranked problems of ``devices(id, name, status, snmp_health,
    last_reported_at)``, ``links(rid, label, a_name, b_name, oper_status,
    flap_state, util_avg_1h, util_pct, error_avg_1h, error_rate_per_s)`` and
    ``sessions(id, label, state, flap_state)``, of one ``severity`` if given.

    A device that is down, or a link whose fresher end hasn't reported for
    ``threshold_s``, gets the stale severity; with ``filter`` it gives no
    finding at all. Use and errors are those of the hour, else the current ones.
    """
    say = lambda *parts: F.concat_ws(" ", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    aged = staleness(F.lit("critical"), F.col("last_reported_at"), F.lit(now_ms), F.lit(threshold_s), F.lit(stale))
    snmp = F.lower(F.coalesce("snmp_health", F.lit("")))
    name, label = F.col("name"), F.col("label")
    flaps = F.when(F.col("flap_state") == "flapping", "critical").otherwise("warning")
    reported = devices.groupBy("name").agg(F.max("last_reported_at").alias("at"))
    for end in ("a", "b"):
        links = links.join(reported.select(F.col("name").alias(f"{end}_name"), F.col("at").alias(f"_{end}_at")), f"{end}_name", "left")
    links = links.withColumns({"last_reported_at": F.greatest("_a_at", "_b_at"), "_use": F.coalesce("util_avg_1h", "util_pct", F.lit(0.0)), "_errors": F.coalesce("error_avg_1h", "error_rate_per_s", F.lit(0.0))})
    broken = lambda rows, bad: rows.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_aged", F.when(F.col("_bad"), aged)).where(~F.col("_bad") | F.col("_aged").isNotNull())
    devices, links = broken(devices, F.lower("status").isin(*DOWN)), broken(links, F.lower("oper_status") == "down")
    rules = [
        _problem(devices.where("_bad"), "device_down", F.col("_aged"), say(name, "is", F.col("status"))),
        _problem(devices.where(snmp == "unreachable"), "snmp_unreachable", "warning", say(name, "does not answer")),
        _problem(devices.where(snmp == "restricted"), "snmp_restricted", "warning", say(name, "restricts its view")),
        _problem(devices.where(snmp == "unpolled"), "snmp_unpolled", "info", say(name, "is not polled")),
        _problem(links.where("_bad"), "link_down", F.col("_aged"), say(label, "is down"), "rid"),
        _problem(links.where(F.col("flap_state").isin("flapping", "unstable")), "link_flapping", flaps, say(label, "is", F.col("flap_state")), "rid"),
        _problem(links.where("_use >= 80"), "high_utilisation", F.when(F.col("_use") >= 95, "critical").otherwise("warning"), say(label, "is busy"), "rid"),
        _problem(links.where("_errors >= 1"), "high_errors", F.when(F.col("_errors") >= 5, "critical").otherwise("warning"), say(label, "has errors"), "rid"),
        _problem(sessions.where("state = 'down'"), "peer_down", "critical", say(label, "is down")),
        _problem(sessions.where(F.col("flap_state").isin("flapping", "unstable")), "peer_flapping", flaps, say(label, "is", F.col("flap_state"))),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.union(r)
    out = out if severity is None else out.where(F.col("severity") == severity)
    out = out.withColumn("rank", F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1)
    out = out.orderBy("rank", "problem_type", "element")
    return out if limit is None else out.limit(max(1, min(500, limit)))
