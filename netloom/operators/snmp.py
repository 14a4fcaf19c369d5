"""Tables of management walks: parsing, pivots and the records made of them.

The input is a walk table (device, oid, kind, value, ts) or text lines; object
identifiers have no leading dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import is_neighbor_name, mac, oui
from netloom.functions.network import cidr, cidr6, ip_version, is_useful_ip, is_vlan

# fixed values: columns of the interface table
IF_COLUMNS = {"1.3.6.1.2.1.2.2.1.2": "descr", "1.3.6.1.2.1.31.1.1.1.1": "name", "1.3.6.1.2.1.31.1.1.1.15": "speed_mbps", "1.3.6.1.2.1.2.2.1.7": "admin", "1.3.6.1.2.1.2.2.1.8": "oper"}
STATES = {"1": "up", "2": "down", "3": "testing", "4": "unknown", "5": "dormant", "6": "notPresent", "7": "lowerLayerDown"}
OSPF = {"1": "down", "2": "attempt", "3": "init", "4": "twoWay", "5": "exchangeStart", "6": "exchange", "7": "loading", "8": "full"}
BGP = {"1": "idle", "2": "connect", "3": "active", "4": "opensent", "5": "openconfirm", "6": "established"}


def parse_lines(lines: DataFrame) -> DataFrame:
    """(oid, kind, value) of ``lines(line)`` like ``.1.3.6 = STRING: "x"``;
    errors and unreadable lines are left out. Quotes go, numbers lose their
    labels, hexadecimal strings their blanks."""
    pattern = r"^\.?([0-9.]+) = (?:([A-Za-z0-9-]+):\s*)?(.*)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    raw, kind = F.trim(part(3)), part(2)
    number = F.regexp_extract(raw, r"^(-?\d+)", 1)
    value = (
        F.when(kind == "STRING", F.regexp_replace(raw, '^"(.*)"$', "$1"))
        .when(kind.isin("INTEGER", "Counter32", "Counter64", "Gauge32", "Unsigned32", "TimeTicks") & (number != ""), number)
        .when(kind.isin("Hex-STRING", "Hex"), F.lower(F.regexp_replace(raw, "[ :]", "")))
        .when(kind == "OID", F.regexp_replace(raw, r"^\.", ""))
        .otherwise(raw)
    )
    good = (part(1) != "") & ~F.coalesce(F.col("line").rlike("= (No Such|End of MIB|No more variables)"), F.lit(False))
    keep = [c for c in lines.columns if c != "line"]
    return lines.where(good).select(*keep, part(1).alias("oid"), F.nullif(kind, F.lit("")).alias("kind"), value.alias("value"))


def column(walk: DataFrame, prefix: str) -> DataFrame:
    """(device, index, value) below one object identifier."""
    return walk.where(F.col("oid").startswith(prefix + ".")).select("device", F.substr("oid", F.lit(len(prefix) + 2)).alias("index"), "value")


def interfaces(walk: DataFrame) -> DataFrame:
    """One row for each interface with the columns of ``IF_COLUMNS``."""
    parts = F.regexp_extract("oid", r"^(.*)\.(\d+)$", 1)
    rows = walk.select("device", F.element_at(F.create_map(*[F.lit(x) for kv in IF_COLUMNS.items() for x in kv]), parts).alias("c"), F.regexp_extract("oid", r"(\d+)$", 1).cast("bigint").alias("ifindex"), "value").where("c is not null")
    wide = rows.groupBy("device", "ifindex").pivot("c", list(IF_COLUMNS.values())).agg(F.min("value"))
    state = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.col(c))
    return wide.select("device", "ifindex", F.coalesce("name", "descr").alias("name"), F.col("speed_mbps").try_cast("bigint").alias("speed_mbps"), state("admin").alias("admin_status"), state("oper").alias("oper_status"))


def learned_macs(cam: DataFrame, ports: DataFrame) -> DataFrame:
    """``cam(device, index, port, ord)``, the index the address in decimal bytes,
    joined to ``ports(device, port, interface)``; the first port of each address."""
    digits = F.array_join(F.transform(F.split("index", r"\."), lambda x: F.lpad(F.lower(F.conv(x, 10, 16)), 2, "0")), ":")
    rows = cam.join(ports, ["device", "port"]).withColumn("mac", mac(digits)).where("mac is not null")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("device", "mac").orderBy("ord", "interface"))).where("_n = 1").select("device", "interface", "mac")


def arp_entries(arp: DataFrame) -> DataFrame:
    return arp.select("device", "ip", mac(F.col("mac")).alias("mac")).where(is_useful_ip(F.col("ip")) & F.col("mac").isNotNull()).dropDuplicates(["ip", "mac"])


def neighbors(announced: DataFrame, limit: int | None = 500) -> DataFrame:
    """Neighbours of ``announced(device, interface, name, chassis, port, mgmt_ip,
    proto)`` with an id: by name if it is one, else by address; the first
    ``limit`` of each device in the order of their ids."""
    by_name = F.when(is_neighbor_name(F.col("name")), F.concat_ws(":", F.concat("proto", F.lit("-neighbor")), F.lower("name")))
    by_id = F.concat_ws(":", F.concat("proto", F.lit("-neighbor")), F.lit("by-id"), F.coalesce(mac(F.col("chassis")), "mgmt_ip"))
    usable = F.coalesce(mac(F.col("chassis")), F.col("mgmt_ip")).isNotNull() | by_name.isNotNull()
    rows = announced.where(usable).withColumn("neighbor", F.coalesce(by_name, by_id))
    return rows if limit is None else rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("device").orderBy("neighbor"))).where(F.col("_n") <= limit).drop("_n")


def vlans(vtp: DataFrame, qbridge: DataFrame) -> DataFrame:
    """(device, vid, name) of the first table that knows the device, reserved numbers left out."""
    fallback = qbridge.join(vtp.select("device").distinct(), "device", "left_anti")
    return vtp.select("device", "vid", "name").union(fallback.select("device", "vid", "name")).where(is_vlan(F.col("vid"))).dropDuplicates(["device", "vid"])


def port_vlans(ports: DataFrame, members: DataFrame) -> DataFrame:
    """``ports(device, interface, trunk_mode, native, access)`` with the VLANs of
    ``members(device, interface, vid)``; trunks list them, others their access VLAN."""
    carried = members.where(is_vlan(F.col("vid"))).groupBy("device", "interface").agg(F.sort_array(F.collect_set("vid")).alias("_v"))
    rows = ports.join(carried, ["device", "interface"], "left")
    return rows.select(*ports.columns, F.when(F.col("trunk_mode") == "trunk", F.col("_v")).alias("vlans_allowed"), F.when(F.col("trunk_mode") != "trunk", F.coalesce("access", F.element_at("_v", 1))).alias("vlans_access"))


def stp_contexts(ports: DataFrame, most: int = 256) -> DataFrame:
    """(device, vlans): numbers carried by any port, the first ``most``; each gets a walk of its own."""
    rows = ports.select("device", F.explode(F.coalesce("vlans_allowed", F.array("vlans_access"))).alias("vid")).where(is_vlan(F.col("vid")))
    return rows.groupBy("device").agg(F.slice(F.sort_array(F.collect_set("vid")), 1, most).alias("vlans"))


def peers(rows: DataFrame, states: dict[str, str], most: int | None = 200, any_address: bool = False) -> DataFrame:
    """``rows(device, peer_ip, state)`` with named states; unusable addresses go
    unless ``any_address`` (as of protocols without states of their own), of a
    device at most ``most`` stay in the order of the addresses."""
    named = (rows if any_address else rows.where(is_useful_ip(F.col("peer_ip")))).withColumn("state", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), F.col("state").cast("string")), F.lit("unknown")))
    return named if most is None else named.withColumn("_n", F.row_number().over(Window.partitionBy("device").orderBy("peer_ip"))).where(F.col("_n") <= most).drop("_n")


def addresses(modern: DataFrame, classic: DataFrame) -> DataFrame:
    """(device, ip, version, prefix_len, prefix) of the newer table, for devices
    without it of the older; without a length /24 and /64."""
    fallback = classic.join(modern.select("device").distinct(), "device", "left_anti")
    rows = modern.select("device", "ip", "prefix_len").union(fallback.select("device", "ip", "prefix_len")).where(is_useful_ip(F.col("ip")))
    rows = rows.withColumn("version", ip_version(F.col("ip"))).withColumn("prefix_len", F.coalesce("prefix_len", F.when(F.col("version") == 4, 24).otherwise(64)))
    return rows.withColumn("prefix", F.when(F.col("version") == 4, cidr(F.col("ip"), F.col("prefix_len"))).otherwise(cidr6(F.col("ip"), F.col("prefix_len"))))


def stp_roots(bridges: DataFrame) -> DataFrame:
    """(domain, device, is_root) of ``bridges(device, root_mac, root_port)``: a bridge without a root port is the root."""
    return bridges.where("root_mac is not null").select(F.concat(F.lit("stp-domain:"), mac(F.col("root_mac"))).alias("domain"), "device", (F.col("root_port") == 0).alias("is_root"))


def stp_edges(bridges: DataFrame, ports: DataFrame) -> DataFrame:
    """(type, src, dst, priority, state, role) of ``bridges(device, root_mac,
    root_port, priority)`` and ``ports(device, port, interface, state, role)``: a
    device is a member of its root's domain (of its own, without a root), is
    root without a root port, and each port that isn't disabled is linked to it."""
    domain = F.coalesce(F.concat(F.lit("stp-domain:"), mac(F.col("root_mac"))), F.concat(F.lit("stp:"), "device", F.lit(":default")))
    own = bridges.withColumn("domain", domain)
    none = F.lit(None).cast("string")
    edge = lambda rows, kind, src, priority, state, role: rows.select(F.lit(kind).alias("type"), src.alias("src"), F.col("domain").alias("dst"), priority.cast("int").alias("priority"), state.alias("state"), role.alias("role"))
    out = edge(own, "STP_MEMBER", F.col("device"), F.coalesce("priority", F.lit(32768)), none, none)
    out = out.union(edge(own.where(F.coalesce("root_port", F.lit(0)) == 0), "STP_ROOT", F.col("device"), F.coalesce("priority", F.lit(32768)), none, none))
    live = ports.where("state <> 'disabled'").join(own.select("device", "domain"), "device")
    name = F.concat(F.lit("snmp-if:"), "device", F.lit(":"), F.coalesce("interface", F.concat(F.lit("port-"), "port")))
    return out.union(edge(live, "STP_LINK", name, F.lit(None), F.col("state"), F.coalesce("role", F.lit("unknown"))))


def polled(devices: DataFrame, targets: DataFrame) -> DataFrame:
    """``devices(id, mgmt_ip, snmp_cloud, snmp_sources)`` after a cycle of
    ``targets(node_id, ip, ok)``: a success marks the device of that id, else
    those of that address, a failure those of the address; others stay as they are."""
    by_id = targets.where("ok").select(F.col("node_id").alias("id")).distinct().withColumn("_id", F.lit(True))
    unknown = targets.where("ok").join(devices.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_anti")
    by_ip = unknown.select(F.col("ip").alias("mgmt_ip")).distinct().withColumn("_ip", F.lit(True))
    failed = targets.where("not ok").select(F.col("ip").alias("mgmt_ip")).distinct().withColumn("_failed", F.lit(True))
    rows = devices.join(by_id, "id", "left").join(by_ip, "mgmt_ip", "left").join(failed, "mgmt_ip", "left")
    good, cloud = F.coalesce("_id", "_ip", F.lit(False)), F.coalesce("snmp_cloud", F.lit(False))
    bad = ~good & F.coalesce("_failed", F.lit(False))
    rest = F.array_remove(F.coalesce("snmp_sources", F.array().cast("array<string>")), "direct")
    return rows.select(
        "id", "mgmt_ip", "snmp_cloud", F.when(good, F.concat(rest, F.array(F.lit("direct")))).when(bad, rest).otherwise(F.col("snmp_sources")).alias("snmp_sources"),
        F.when(good, True).when(bad, cloud).alias("snmp_polled"), F.when(good, "ok").when(bad & cloud, "cloud_ok").when(bad, "unreachable").alias("snmp_last_status"),
        F.when(good & cloud, "direct+cloud").when(good, "direct").when(bad & cloud, "meraki_cloud").alias("snmp_source"), F.when(bad & cloud, "cloud_only").when(bad, "unreachable").alias("snmp_health"),
    )


def undiscovered(targets: DataFrame, devices: DataFrame) -> DataFrame:
    """(id, name, mgmt_ip) of the ``targets(node_id, ip, name, ok)`` that answered and whose address no device has."""
    rows = targets.where("ok").join(devices.select(F.col("mgmt_ip").alias("ip")).distinct(), "ip", "left_anti")
    return rows.groupBy(F.col("node_id").alias("id")).agg(F.min(F.coalesce("name", "ip")).alias("name"), F.min("ip").alias("mgmt_ip"))


def vendors(addresses: DataFrame, known: DataFrame) -> DataFrame:
    """``addresses(mac)`` with the vendor of ``known(prefix, vendor)``; none for locally administered ones."""
    one = known.groupBy(F.upper("prefix").alias("_p")).agg(F.min("vendor").alias("vendor"))
    return addresses.join(one, oui(F.col("mac")) == F.col("_p"), "left").drop("_p")


def coverage(probes: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """(device, snmp_health, missing_required, restricted) of ``probes(device,
    family, status, required)``; of ``devices(device)`` those without a probe
    are unreachable."""
    missing = F.col("required") & (F.col("status") != "ok")
    health = F.when(F.bool_or(missing & (F.col("status") == "restricted")), "restricted").when(F.bool_or(missing), "partial").otherwise("full")
    lists = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("family"))))
    rows = probes.groupBy("device").agg(health.alias("snmp_health"), lists(missing).alias("missing_required"), lists(F.col("status") == "restricted").alias("restricted"))
    if devices is None:
        return rows
    none = F.array().cast("array<string>")
    return devices.select("device").distinct().join(rows, "device", "left").select("device", F.coalesce("snmp_health", F.lit("unreachable")).alias("snmp_health"), *(F.coalesce(c, none).alias(c) for c in ("missing_required", "restricted")))


def arp_text(outputs: DataFrame) -> DataFrame:
    """(device, ip, mac, interface) of ``outputs(device, text)`` of ``show ip arp``."""
    pattern = r"^Internet\s+(\d+\.\d+\.\d+\.\d+)\s+\S+\s+([0-9a-fA-F.]{14})\s+ARPA(?:\s+(\S+))?"
    rows = outputs.select("device", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(pattern))
    return rows.select("device", F.regexp_extract("line", pattern, 1).alias("ip"), mac(F.regexp_extract("line", pattern, 2)).alias("mac"), F.nullif(F.regexp_extract("line", pattern, 3), F.lit("")).alias("interface"))


def shard_of(target: Column, shards: int) -> Column:
    """A stable shard of a target, by the first 8 bytes of its digest."""
    return F.pmod(F.conv(F.substring(F.md5(target), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(shards).cast("decimal(20,0)")).cast("int")


def owners(targets: DataFrame, pollers: DataFrame) -> DataFrame:
    """(target, poller): the owner of each of ``targets(target)`` is the one of
    ``pollers(poller)`` whose place in their order is the target's shard. The
    pollers of a cohort are few; no pollers own nothing."""
    cohort = sorted(r["poller"] for r in pollers.distinct().collect())
    if not cohort:
        return targets.select("target", F.lit(None).cast("string").alias("poller")).limit(0)
    return targets.select("target", F.element_at(F.array(*map(F.lit, cohort)), shard_of(F.col("target"), len(cohort)) + 1).alias("poller"))


def targets(devices: DataFrame, failed: DataFrame, now_ms: int, limit: int = 2000, quiet_ms: int = 600_000) -> DataFrame:
    """Addresses to poll: of ``devices(id, mgmt_ip, candidate_ips, known_good)``
    those that didn't fail lately (``failed(ip, at)``), known good ones first."""
    rows = devices.select("id", "known_good", F.explode(F.array_distinct(F.filter(F.concat(F.array("mgmt_ip"), F.coalesce("candidate_ips", F.array().cast("array<string>"))), lambda x: x.isNotNull()))).alias("ip"))
    rows = rows.where(is_useful_ip(F.col("ip"))).join(failed.where(F.col("at") >= now_ms - quiet_ms).select("ip").distinct(), "ip", "left_anti")
    one = rows.groupBy("ip").agg(F.min("id").alias("id"), F.bool_or("known_good").alias("known_good"))
    return one.orderBy(F.desc_nulls_last("known_good"), "ip").limit(limit)
