"""Queries of decoders, name and health expressions, summaries and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import decode, health, names, network
from netloom.operators import decorate, housekeeping, links as cables, reconcile, report, snmp, summary, timeseries, vlan_evidence
from netloom.plans.catalog import query
from netloom.plans.graph import DEVICES, LINES, STEPS, devices, lines, table, topology


def key() -> Column:
    return F.col("s_suppkey")


@query("name_expressions", """
WITH x AS (SELECT *, lpad(lower(to_hex(s_suppkey * 7919)), 12, '0') AS h FROM supplier)
SELECT s_suppkey AS k, s_suppkey % 3 = s_suppkey % 2 AS same_port, substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2) || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) AS bridge,
  CASE WHEN s_suppkey % 2 = 0 THEN '0050F2' END AS vendor, s_name || ' x' AS collapsed, 'supplier-' || substr(s_name, 10) AS dashed, 'supplier' || substr(s_name, 10) AS slug,
  s_suppkey % 4 > 0 AS usable, 'Ethernet' || CASE WHEN s_suppkey % 3 = 0 THEN '1' ELSE (s_suppkey % 3)::VARCHAR END || '/' || s_suppkey % 5 AS port,
  CASE WHEN s_suppkey % 5 > 0 THEN s_name ELSE 's' || s_suppkey END AS label, CASE WHEN s_suppkey % 4 > 0 THEN 'VLAN ' || s_suppkey % 4 WHEN s_suppkey % 8 = 0 THEN 'Root r' ELSE 'b' END AS domain,
  [0, 1, 2, 3, 4, 5][s_suppkey % 6 + 1] AS rank, 'a' || s_suppkey AS left_name, 'b' AS right_name FROM x""")  # fmt: skip
def name_expressions(spark: SparkSession, folder: str) -> DataFrame:
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    pair = names.link_pair(F.when(key() % 2 == 0, text("a", key(), " <-> b")).otherwise(text(" a", key(), "|b ")))
    order = F.element_at(F.array(*map(F.lit, ("other", "snmp", "meraki/x", "nexus_dashboard/y", "intersight", "catalyst_center/z"))), (key() % 6 + 1).cast("int"))
    return table(spark, folder, "supplier").select(
        key().alias("k"), names.ifname_equal(text("Gi", key() % 3, "/1"), text("GigabitEthernet", key() % 2, "/1")).alias("same_port"),
        names.bridge_mac(text("8000", F.lpad(F.hex(key() * 7919), 12, "0"))).alias("bridge"),
        names.oui(F.when(key() % 2 == 0, "00:50:f2:00:00:01").otherwise("02:50:f2:00:00:01")).alias("vendor"),
        names.collapse(text("  ", F.col("s_name"), " \t x ")).alias("collapsed"), names.dashed(F.col("s_name")).alias("dashed"), names.slug(F.col("s_name")).alias("slug"),
        names.is_neighbor_name(F.when(key() % 4 == 0, "12345").when(key() % 4 == 1, "sw-1.x_y").otherwise("abc")).alias("usable"),
        names.fi_port(F.when(key() % 3 > 0, key() % 3), key() % 5).alias("port"), names.label(F.when(key() % 5 == 0, "").otherwise(F.col("s_name")), F.lit(None).cast("string"), text("s", key())).alias("label"),
        names.stp_name(F.lit("stp-domain:a:b"), key() % 4, F.when(key() % 8 == 0, "r")).alias("domain"), names.adapter_rank(order).alias("rank"), pair["a"].alias("left_name"), pair["b"].alias("right_name"),
    )


@query("health_expressions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS reach, CASE l_partkey % 4 WHEN 0 THEN 'vlan_subnet' WHEN 1 THEN 'static_route' END AS kind,
  CASE WHEN l_partkey % 7 = 0 THEN 80 WHEN l_partkey % 7 = 1 THEN 0 ELSE least(100, CASE WHEN l_quantity * 2 >= 95 THEN 80 WHEN l_quantity * 2 >= 80 THEN 50 WHEN l_quantity * 2 >= 50 THEN 20 ELSE 0 END + CASE WHEN l_linenumber - 1 >= 10 THEN 60 WHEN l_linenumber - 1 >= 1 THEN 30 WHEN l_linenumber > 1 THEN 10 ELSE 0 END) END AS score,
  CASE WHEN l_quantity * 2 >= 95 THEN 80 WHEN l_quantity * 2 >= 85 THEN 60 WHEN l_quantity * 2 >= 75 THEN 40 WHEN l_quantity * 2 >= 65 THEN 25 ELSE 0 END AS penalty,
  least(1.0, l_linenumber / 6.0)::DOUBLE AS flap, CASE WHEN l_linenumber >= 5 THEN 'flapping' WHEN l_quantity >= 5 THEN 'unstable' ELSE 'stable' END AS flap_state,
  ['active', 'alerting', 'down'][l_partkey % 3 + 1] AS firewall, CASE l_partkey % 4 WHEN 0 THEN 'down' WHEN 1 THEN 'down' WHEN 2 THEN 'alerting' ELSE 'active' END AS agent, CASE WHEN l_partkey % 2 = 0 THEN 'down' ELSE 'active' END AS endpoint,
  ['up', 'down', 'up', 'down', 'unknown'][l_partkey % 5 + 1] AS uplink, l_partkey % 3 > 0 AS flag,
  ['100base-tx', '1000base-t', '10gbase-x-sfpp', '25gbase-x-sfp28', '40gbase-x-qsfpp', '100gbase-x-qsfp28', '400gbase-x-qsfpdd'][l_linenumber] AS port_type, l_partkey % 100 * CASE l_partkey % 3 WHEN 0 THEN 1000.0 WHEN 1 THEN 1.0 ELSE 0.001 END AS mbps FROM lineitem""")  # fmt: skip
def health_expressions(spark: SparkSession, folder: str) -> DataFrame:
    part, line, use = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity") * 2
    of = lambda column, *texts: F.element_at(F.array(*map(F.lit, texts)), (column % len(texts) + 1).cast("int"))
    agent = health.agent_status(F.when(part % 4 == 0, F.lit(False)).otherwise(F.lit(True)), of(part, "online", "Offline", "limited", "ok"), F.lit(0))
    speed = F.concat((part % 100).cast("string"), of(part, " Gbps", " Mbps", " Kbps"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", health.reachability(of(part, "Reachable", " unreachable", "?")).alias("reach"), health.scope_kind(of(part, "VLAN6", "static", "?", "")).alias("kind"),
        health.port_score(use, line - 1, of(part, "down", "disabled", "up", "up", "up", "up", "up")).alias("score"), health.util_penalty(use).alias("penalty"),
        health.flap_score(line).cast("double").alias("flap"), health.flap_state(line, F.col("l_quantity")).alias("flap_state"), health.firewall_status(of(part, "fine", "Degraded", "link DOWN")).alias("firewall"),
        agent.alias("agent"), health.endpoint_status(of(part, "Disabled", "on")).alias("endpoint"), health.uplink_oper(of(part, "UP", "down", "x", "x", "x"), of(part, "x", "x", "online", "dormant", "x")).alias("uplink"),
        health.to_bool(of(part, "No", "yes", "1")).alias("flag"), health.interface_type(F.element_at(F.array(*map(F.lit, (100, 1000, 10_000, 25_000, 40_000, 100_000, 400_000))), line.cast("int"))).alias("port_type"),
        health.speed_mbps(speed).alias("mbps"),
    )


@query("address_expressions", """
SELECT s_suppkey AS k, ['0.0.0.0', '127.0.0.1', '169.254.1.1', '224.0.0.5', '10.0.0.1', '::1', 'fe80::1', '2001:db8::1', 'x'][s_suppkey % 9 + 1] AS ip, s_suppkey % 9 IN (3, 4, 7) AS pollable, s_suppkey % 9 IN (4, 7) AS useful,
  CASE WHEN s_suppkey % 2 = 0 THEN '10.0.0.' || s_suppkey % 250 || '/32' ELSE '2001:db8::' || s_suppkey % 250 || '/128' END AS cidr, s_suppkey * 50 BETWEEN 1 AND 4094 AND NOT s_suppkey * 50 BETWEEN 1002 AND 1005 AS vlan,
  s_name AS isp, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS asn FROM supplier""")  # fmt: skip
def address_expressions(spark: SparkSession, folder: str) -> DataFrame:
    ip = F.element_at(F.array(*map(F.lit, ("0.0.0.0", "127.0.0.1", "169.254.1.1", "224.0.0.5", "10.0.0.1", "::1", "fe80::1", "2001:db8::1", "x"))), (key() % 9 + 1).cast("int"))
    host = F.when(key() % 2 == 0, F.concat(F.lit("10.0.0."), key() % 250)).otherwise(F.concat(F.lit("2001:db8::"), key() % 250))
    provider = network.network_asn(F.when(key() % 2 == 0, F.concat("s_name", F.lit(" (AS "), key(), F.lit(")"))).otherwise(F.col("s_name")))
    return table(spark, folder, "supplier").select(key().alias("k"), ip.alias("ip"), network.is_pollable(ip).alias("pollable"), network.is_useful_ip(ip).alias("useful"), network.ensure_cidr(host).alias("cidr"), network.is_vlan(key() * 50).alias("vlan"), provider["isp"].alias("isp"), provider["asn"].alias("asn"))


@query("walk_decoders", """
SELECT s_suppkey AS k, s_name AS display, CASE WHEN s_suppkey % 2 = 0 THEN 'Ethernet1/' || s_suppkey % 9 ELSE '61:62:63:64:65:6' || s_suppkey % 9 END AS port, '10.0.' || s_suppkey % 256 || '.1' AS from_number, '10.1.' || s_suppkey % 200 || '.2' AS from_oid,
  CASE WHEN s_suppkey % 2 = 0 THEN '10.0.0.' || s_suppkey % 250 ELSE '2001:db8::' || CASE WHEN s_suppkey % 250 > 0 THEN lower(to_hex(s_suppkey % 250)) ELSE '' END END AS inet, CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 6 END AS version,
  CASE WHEN s_suppkey % 200 <= 128 THEN (s_suppkey % 200)::INTEGER END AS length FROM supplier""")  # fmt: skip
def walk_decoders(spark: SparkSession, folder: str) -> DataFrame:
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    raw = F.when(key() % 2 == 0, F.encode(text("Ethernet1/", key() % 9), "UTF-8")).otherwise(F.encode(text("abcde", F.chr((key() % 9 + 96).cast("int"))), "UTF-8"))
    index = F.when(key() % 2 == 0, text("1.4.10.0.0.", key() % 250)).otherwise(text("2.16.32.1.13.184.0.0.0.0.0.0.0.0.0.0.0.", key() % 250))
    inet = decode.inet_index(index)
    return table(spark, folder, "supplier").select(
        key().alias("k"), decode.display_text(F.encode(text("\u0001 ", F.col("s_name"), "\u0000 "), "UTF-8")).alias("display"), decode.port_id(raw).alias("port"), decode.ip_value(text(F.lit(167772161) + key() % 256 * 256)).alias("from_number"),
        decode.oid_tail_ip(text("1.3.6.1.10.1.", key() % 200, ".2")).alias("from_oid"), inet["ip"].alias("inet"), inet["version"].alias("version"), decode.oid_prefix_length(text("1.3.6.1.2.1.4.32.1.5.", key() % 200)).alias("length"),
    )


@query("stored_properties", """
SELECT s_suppkey AS k, '[[' || (7200000 + s_suppkey) || ',1.5,2],[' || (9000000 + s_suppkey) || ',2.25,1]]' AS history, 1 AS kept, 'oper_changed_at' AS field, 'h' || s_suppkey AS named, 'id:neo4j,x' AS drawn, 'x' AS stored,
  [1, 2, s_suppkey + 10] AS vlans, 'n' || s_suppkey AS network FROM supplier""")  # fmt: skip
def stored_properties(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("[["), F.lit(9000000) + key(), F.lit(",2.25],["), F.lit(7200000) + key(), F.lit(",1.5,2],[1],[\"x\",1,1]]"))
    history = decode.parse_hourly(raw)
    props = F.create_map(F.lit("id"), F.lit("a"), F.lit("x"), F.lit("b"), F.lit("oper_history"), F.concat(F.lit("h"), key()))
    drawn = F.array_join(F.array_sort(F.filter(F.map_keys(decode.drawable(props)), lambda n: ~n.endswith("history"))), ",")
    stored = F.array_join(F.filter(F.map_keys(decode.storable(props)), lambda n: ~n.endswith("history")), ",")
    return table(spark, folder, "supplier").select(
        key().alias("k"), decode.serialize_hourly(history).alias("history"), F.size(decode.trim_hourly(history, F.lit(8_000_000) + key(), 500_000)).alias("kept"), decode.changed_at(F.lit("oper")).alias("field"),
        decode.history_property(props, F.lit("oper")).alias("named"), F.regexp_replace(drawn, "neo4j_id", "id:neo4j").alias("drawn"), stored.alias("stored"),
        decode.replaced(F.array(F.lit(1), F.lit(3)), F.array(F.lit(3)), F.array(F.lit(2), (key() + 10).cast("int"))).alias("vlans"), decode.last_part(F.when(key() % 2 == 0, F.concat(F.lit("a:n"), key())).otherwise(F.concat(F.lit("n"), key()))).alias("network"),
    )


def _typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("PHYSICAL_LINK", "ROUTING_PEER", "WAN_UPLINK", "ROUTES_TO", "HAS_SVI"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    return lines(spark, folder).select(kind.alias("type"), "src", "dst", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"))


_TYPED = "typed AS (SELECT ['PHYSICAL_LINK', 'ROUTING_PEER', 'WAN_UPLINK', 'ROUTES_TO', 'HAS_SVI'][l_partkey % 5 + 1] AS type, src, dst, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rid FROM lines)"


@query("graph_summary", f"""
WITH {DEVICES}, {LINES}, {_TYPED} SELECT 'node' AS section, 'Device' AS name, count(*) AS n FROM devices UNION ALL SELECT 'edge', type, count(*) FROM typed GROUP BY type UNION ALL SELECT 'role', role, count(*) FROM devices GROUP BY role
UNION ALL SELECT * FROM (SELECT 'site', n_name, NULL FROM nation ORDER BY n_name LIMIT 20)""")  # fmt: skip
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    known = devices(spark, folder)
    return summary.graph_summary(known.withColumn("type", F.lit("Device")), _typed_edges(spark, folder), known, table(spark, folder, "nation").select(F.col("n_name").alias("name")))


@query("status_document", f"""
WITH {DEVICES}, a AS (SELECT * FROM (VALUES ('c', 'up'), ('s', 'down'), ('none', 'up')) v(adapter, state)), n AS (SELECT source_adapter AS adapter, count(*) FILTER (balance > 0) AS ok, count(*) AS total FROM devices GROUP BY 1)
SELECT adapter, state, ok, total FROM a LEFT JOIN n USING (adapter)""")  # fmt: skip
def status_document(spark: SparkSession, folder: str) -> DataFrame:
    adapters = spark.createDataFrame([("c", "up"), ("s", "down"), ("none", "up")], "adapter string, state string")
    return summary.status_document(adapters, devices(spark, folder).withColumn("snmp_polled", F.col("balance") > 0))


@query("dominant_slug", f"""
WITH {DEVICES}, n AS (SELECT nation AS platform_site, role AS slug, count(*) AS n FROM devices GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY platform_site ORDER BY n DESC, slug) AS k FROM n)
SELECT platform_site, slug FROM r WHERE k = 1""")  # fmt: skip
def dominant_slug(spark: SparkSession, folder: str) -> DataFrame:
    return summary.dominant_slug(devices(spark, folder).select(F.col("nation").alias("platform_site"), F.col("role").alias("slug")))


@query("domain_peers", f"""
WITH {STEPS}, {DEVICES}, z AS (SELECT nation, count(*) AS size FROM devices GROUP BY 1), p AS (SELECT t.src AS id, count(*) AS n FROM steps t JOIN devices a ON a.id = t.src JOIN devices b ON b.id = t.dst WHERE a.nation = b.nation GROUP BY 1)
SELECT d.id, coalesce(n, 0) AS peers, size FROM devices d JOIN z USING (nation) LEFT JOIN p ON p.id = d.id""")  # fmt: skip
def domain_peers(spark: SparkSession, folder: str) -> DataFrame:
    return summary.domain_peers(devices(spark, folder).select("id", F.col("nation").alias("domain")), topology(spark, folder))


@query("truncated_page", f"""
WITH {DEVICES} SELECT id, (SELECT count(*) FROM devices) AS total, 500 AS "limit", least(500, (SELECT count(*) FROM devices)) AS returned, (SELECT count(*) FROM devices) > 500 AS truncated FROM devices ORDER BY id LIMIT 500""")  # fmt: skip
def truncated_page(spark: SparkSession, folder: str) -> DataFrame:
    return summary.envelope(devices(spark, folder).select("id"), 9999, "id")


@query("listed_links", f"""
WITH {DEVICES}, {LINES}, {_TYPED} SELECT type, src, dst, rid, a.name AS src_name, b.name AS dst_name FROM typed JOIN devices a ON a.id = src JOIN devices b ON b.id = dst WHERE type IN ('PHYSICAL_LINK', 'ROUTING_PEER', 'WAN_UPLINK', 'VXLAN_TUNNEL')""")  # fmt: skip
def listed_links(spark: SparkSession, folder: str) -> DataFrame:
    return summary.listed_links(_typed_edges(spark, folder), devices(spark, folder))


@query("tunnel_mesh", """
SELECT 's' || a.s_suppkey AS src, 's' || b.s_suppkey AS dst, a.s_nationkey AS fabric FROM supplier a JOIN supplier b USING (s_nationkey) WHERE 's' || a.s_suppkey < 's' || b.s_suppkey""")  # fmt: skip
def tunnel_mesh(spark: SparkSession, folder: str) -> DataFrame:
    return summary.tunnel_mesh(table(spark, folder, "supplier").select(F.concat(F.lit("s"), key()).alias("id"), F.col("s_nationkey").alias("fabric")))


@query("stub_by_canonical_id", """
SELECT 'lldp-neighbor:' || s_suppkey AS stub, 's' || (s_suppkey + 1) AS canonical FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)""")  # fmt: skip
def stub_by_canonical_id(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    target = F.when(key() % 2 == 0, F.concat(F.lit("s"), key() + 1)).when(key() % 3 == 0, "").when(key() % 5 == 0, F.concat(F.lit("cdp-neighbor:"), key()))
    stubs = s.select(F.concat(F.lit("lldp-neighbor:"), key()).alias("id"), target.alias("canonical_id"))
    return summary.by_canonical_id(stubs.union(s.select(F.concat(F.lit("s"), key()), F.lit(None).cast("string"))))


@query("canonical_names", """
SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'TenGigabitEthernet1/' || s_suppkey END AS name_canonical FROM supplier""")  # fmt: skip
def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").select(key().alias("k"), F.when(key() % 3 < 2, F.concat(F.lit("Te1/"), key())).alias("name"), F.when(key() % 3 == 0, "kept").otherwise("").alias("name_canonical"))
    return summary.canonical_names(rows).select("k", F.nullif("name_canonical", F.lit("")).alias("name_canonical"))


@query("mismatch_report", f"""
WITH {DEVICES} SELECT name AS device, nation AS netbox_id, 'b' || id AS site_delta, role AS observed_site FROM (SELECT * FROM devices WHERE nation % 2 = 0 ORDER BY id LIMIT 500)""")  # fmt: skip
def mismatch_report(spark: SparkSession, folder: str) -> DataFrame:
    delta = F.when(F.col("nation") % 2 == 0, F.concat(F.lit('{"site": "b'), "id", F.lit('"}'))).otherwise("")
    rows = devices(spark, folder).select("id", "name", F.lit(None).cast("string").alias("display_name"), F.col("nation").alias("netbox_id"), F.lit(None).cast("string").alias("canonical_id"), delta.alias("netbox_delta"), F.col("role").alias("netbox_site_slug"))
    return summary.site_mismatches(rows).select("device", "netbox_id", F.col("delta")["site"].alias("site_delta"), "observed_site")


@query("absent_report", f"""
WITH {DEVICES} SELECT id, name AS device, 'ps' || nation AS platform_site FROM devices WHERE nation % 5 = 1 AND balance > 0 ORDER BY id LIMIT 500""")  # fmt: skip
def absent_report(spark: SparkSession, folder: str) -> DataFrame:
    known = devices(spark, folder)
    rows = known.select("id", "name", F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("canonical_id"), (F.col("balance") <= 0).alias("stub"), F.when(F.col("nation") % 5 == 1, '{"type": "absent_in_netbox"}').alias("netbox_delta"))
    return summary.absent_report(rows, known.select("id", F.concat(F.lit("ps"), "nation").alias("site")))


@query("device_explorer", f"""
WITH {DEVICES}, {LINES}, {_TYPED} SELECT 's5' AS device, type AS section, count(*) AS n FROM typed WHERE dst = 's5' GROUP BY type UNION ALL SELECT 's5', 'orders', count(*) FROM lineitem WHERE l_suppkey = 5""")  # fmt: skip
def device_explorer(spark: SparkSession, folder: str) -> DataFrame:
    edges = _typed_edges(spark, folder)
    sections = {t: (edges.where(F.col("type") == t).select("dst", "src", "rid"), "dst") for t in ("PHYSICAL_LINK", "ROUTING_PEER", "WAN_UPLINK", "ROUTES_TO", "HAS_SVI")}
    sections["orders"] = (table(spark, folder, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("device"), "l_orderkey", "l_linenumber"), "device")
    return summary.explorer_counts(summary.explore(devices(spark, folder).withColumn("stub", F.lit(False)), "SUPPLIER#000000005", sections))


@query("full_graph", f"""
WITH {DEVICES}, {LINES}, {_TYPED}, inside AS (SELECT t.* FROM typed t JOIN devices a ON a.id = t.src WHERE a.nation = 3),
main AS (SELECT * FROM inside WHERE type IN ('PHYSICAL_LINK', 'ROUTES_TO', 'BGP_PEER', 'VRF_MEMBER', 'ROUTING_PEER', 'ASSIGNED_IP') ORDER BY type, src, dst, rid LIMIT 2000)
SELECT * FROM main UNION SELECT * FROM inside WHERE type = 'PHYSICAL_LINK'""")  # fmt: skip
def full_graph(spark: SparkSession, folder: str) -> DataFrame:
    blank = F.lit(None).cast("string")
    known = devices(spark, folder).select("id", F.lit("Device").alias("type"), blank.alias("canonical_id"), blank.alias("absorbed_by"), blank.alias("site"), "nation")
    placed = known.select("id", F.concat(F.lit("ps"), "nation").alias("parent")).union(table(spark, folder, "nation").select(F.concat(F.lit("ps"), "n_nationkey"), F.concat(F.lit("site"), "n_nationkey")))
    return report.full_graph(known, _typed_edges(spark, folder), ["l3"], "site3", placed)[1]


@query("ip_lookup", """
SELECT 'prefix' AS kind, 'c' || c_custkey AS device, 'if' || c_custkey % 9 AS interface, '10.7.0.0/16' AS value FROM customer WHERE c_nationkey = 7""")  # fmt: skip
def ip_lookup(spark: SparkSession, folder: str) -> DataFrame:
    prefixes = table(spark, folder, "nation").select(F.col("n_nationkey").alias("prefix_id"), F.concat(F.lit("10."), "n_nationkey", F.lit(".0.0/16")).alias("cidr"), F.lit(None).cast("string").alias("prefix"))
    routes = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("device"), F.concat(F.lit("if"), F.col("c_custkey") % 9).alias("interface"), F.col("c_nationkey").alias("prefix_id"), F.concat(F.lit("10."), "c_nationkey", F.lit(".0."), F.col("c_custkey") % 250).alias("ip"))
    cabled = topology(spark, folder).select("src", "dst", F.lit("x").alias("interface_a"), F.array(F.lit("10.99.0.0/16")).alias("prefixes"))
    return report.ip_lookup(prefixes, routes.select("ip", "device", "interface"), routes, cabled, "10.7.0.0/16")


@query("clean_up", f"""
WITH {DEVICES} SELECT id, CASE nation % 3 WHEN 0 THEN 'vlan:' || id WHEN 1 THEN 'snmp-if:10.0.0.1:' || id END AS node FROM devices WHERE nation % 3 < 2""")  # fmt: skip
def clean_up(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("nation") % 3
    rows = devices(spark, folder).select(F.when(n == 0, "VLAN").when(n == 1, "Interface").otherwise("Device").alias("type"), F.when(n == 0, F.concat(F.lit("vlan:"), "id")).when(n == 1, F.concat(F.lit("snmp-if:10.0.0.1:"), "id")).otherwise(F.col("id")).alias("id"), F.lit(None).cast("string").alias("platform_site_id"), "name")
    return housekeeping.malformed(rows).select(F.element_at(F.split("id", ":"), -1).alias("id"), F.col("id").alias("node"))


@query("freshness", """
SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 99 END AS first_seen, CASE WHEN s_suppkey % 3 = 1 THEN 7 ELSE 99 END AS last_seen, CASE s_suppkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 7 ELSE 99 END AS changed_at FROM supplier""")  # fmt: skip
def freshness(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("int")
    return housekeeping.freshness(table(spark, folder, "supplier").select(key().alias("k"), F.when(key() % 3 == 0, 5).alias("first_seen"), F.when(key() % 3 == 1, 7).alias("last_seen"), none.alias("changed_at")), 99)


@query("coverage_marks", """
SELECT s_suppkey AS k, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS cloud_covered FROM supplier""")  # fmt: skip
def coverage_marks(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    own = s.select(key().alias("id"), F.concat(F.lit("sn"), key()).alias("serial"), F.lit(None).cast("string").alias("mac"), F.col("s_name").alias("name"))
    cloud = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("SN"), key()).alias("serial"), F.lit("m").alias("mac"), F.lit("n").alias("name")).union(s.where("s_suppkey % 3 = 0").select(F.lit("x"), F.lit("y"), F.upper("s_name")))
    return housekeeping.coverage_marks(own, cloud).select(F.col("id").alias("k"), "cloud_covered")


@query("vlan_counts", f"""
WITH {DEVICES} SELECT lower(name) AS device, count(DISTINCT v) AS vlan_count FROM (SELECT name, nation AS v FROM devices UNION ALL SELECT name, nation + 1 FROM devices) GROUP BY 1""")  # fmt: skip
def vlan_counts(spark: SparkSession, folder: str) -> DataFrame:
    known = devices(spark, folder)
    return housekeeping.vlan_counts(known.select(F.upper("name").alias("device_name"), F.array("nation").alias("vlans")).union(known.select("name", F.array(F.col("nation"), F.col("nation") + 1)))).withColumn("vlan_count", F.col("vlan_count").cast("bigint"))


@query("source_election", f"""
WITH {DEVICES} SELECT nation AS site, min(id) FILTER (source_adapter = 's') AS node FROM devices GROUP BY nation HAVING count(*) FILTER (source_adapter = 's') > 0""")  # fmt: skip
def source_election(spark: SparkSession, folder: str) -> DataFrame:
    rows = devices(spark, folder).select(F.col("nation").alias("site"), F.col("id").alias("node"), F.when(F.col("source_adapter") == "s", "meraki/x").otherwise("snmp").alias("source_adapter"), F.lit(False).alias("stub"))
    some = devices(spark, folder).where("source_adapter = 's'").select(F.col("nation").alias("site")).distinct()
    return reconcile.elect(rows.join(some, "site", "left_semi"), "site").select("site", "node")


@query("missing_addresses", """
SELECT 's' || s_suppkey AS device, '10.0.0.' || s_suppkey || '/24' AS address FROM supplier WHERE s_suppkey % 3 > 0""")  # fmt: skip
def missing_addresses(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    return reconcile.missing_addresses(s.select(F.concat(F.lit("s"), key()).alias("device"), F.concat(F.lit("10.0.0."), key(), F.lit("/24")).alias("address")), s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("10.0.0."), key(), F.lit("/32")).alias("address")))


@query("missing_cables", f"""
WITH {LINES}, e AS (SELECT DISTINCT src, dst, 'gi' || l_linenumber AS a, 'te' || l_linenumber AS b, l_partkey % 2 = 0 AS cabled FROM lines)
SELECT DISTINCT src, dst, a, b FROM e x WHERE NOT cabled AND NOT EXISTS (SELECT 1 FROM e y WHERE y.cabled AND x.src = y.src AND x.dst = y.dst AND x.a = y.a)""")  # fmt: skip
def missing_cables(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).select("src", "dst", F.concat(F.lit("Gi"), "l_linenumber").alias("interface_a"), F.concat(F.lit("Te"), "l_linenumber").alias("interface_b"), F.when(F.col("l_partkey") % 2 == 1, "lldp").otherwise("cdp").alias("proto"))
    cabled = rows.where("proto = 'cdp'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.upper("interface_b").alias("interface_a"), F.col("interface_a").alias("interface_b"))
    return reconcile.missing_cables(rows, cabled, ("lldp",)).select("src", "dst", F.lower("interface_a").alias("a"), F.lower("interface_b").alias("b"))


@query("network_sites", """
SELECT s_nationkey AS network, min(s_suppkey % 2) AS site FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey % 2) = 1""")  # fmt: skip
def network_sites(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.network_sites(table(spark, folder, "supplier").select(F.col("s_nationkey").alias("network"), (key() % 2).alias("site")))


@query("peer_devices", """
WITH d AS (SELECT s_suppkey AS k, '10.0.0.' || s_suppkey % 40 AS ip, '10.0.0.' || (s_suppkey + 20) % 60 AS mgmt FROM supplier), keys AS (SELECT ip, 0 AS r, 's' || k AS id FROM d UNION ALL SELECT mgmt, 1, 's' || k FROM d),
best AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY r, id) AS n FROM keys)
SELECT c_custkey AS peer, id AS remote_device FROM customer LEFT JOIN best ON ip = '10.0.0.' || c_custkey % 80 AND n = 1""")  # fmt: skip
def peer_devices(spark: SparkSession, folder: str) -> DataFrame:
    ip = lambda k: F.concat(F.lit("10.0.0."), k)
    known = table(spark, folder, "supplier").select(F.concat(F.lit("s"), key()).alias("id"), F.array(ip(key() % 40)).alias("ips"), ip((key() + 20) % 60).alias("mgmt_ip"), F.lit(None).cast("array<string>").alias("candidate_ips"))
    peers = table(spark, folder, "customer").select(F.col("c_custkey").alias("peer"), ip(F.col("c_custkey") % 80).alias("peer_ip"))
    return decorate.match_peers(peers, known).select("peer", "remote_device")


@query("adjacencies", f"""
WITH {LINES} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(CASE WHEN l_linenumber % 2 = 0 THEN 'up' ELSE 'down' END) AS state FROM lines GROUP BY 1, 2""")  # fmt: skip
def adjacencies(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("l_linenumber") % 2 == 0
    side = lambda a, b: F.when(turn, b).otherwise(a)
    ip = lambda end: F.concat(F.lit("ip-"), end)
    rows = lines(spark, folder).select(F.lit("bgp").alias("proto"), side(F.col("src"), F.col("dst")).alias("device"), side(F.col("dst"), F.col("src")).alias("remote_device"), side(ip("src"), ip("dst")).alias("local_ip"), side(ip("dst"), ip("src")).alias("peer_ip"), F.lit(1).alias("local_as"), F.lit(1).alias("remote_as"), F.when(turn, "Established").otherwise("idle").alias("state"))
    return decorate.adjacencies(rows).select("src", "dst", "state")


@query("vlan_prefix_evidence", """
SELECT s_suppkey % 10 AS vlan, '10.0.' || s_suppkey % 7 || '.0/24' AS prefix, bool_or(s_suppkey % 2 = 0) AS via_svi, bool_or(s_suppkey % 2 = 1) AS via_ipam FROM supplier GROUP BY 1, 2""")  # fmt: skip
def vlan_prefix_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = lambda odd: table(spark, folder, "supplier").where(key() % 2 == odd).select((key() % 10).alias("vlan"), F.concat(F.lit("10.0."), key() % 7, F.lit(".0/24")).alias("prefix"))
    return decorate.vlan_prefixes(("svi", rows(0)), ("ipam", rows(1)))


@query("interface_walk", """
SELECT 'd' || s_nationkey AS device, s_suppkey AS ifindex, 'Gi' || s_suppkey AS name, s_suppkey % 40 AS speed_mbps, CASE s_suppkey % 3 WHEN 1 THEN 'up' WHEN 2 THEN 'down' END AS oper_status FROM supplier""")  # fmt: skip
def interface_walk(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").withColumn("device", F.concat(F.lit("d"), "s_nationkey"))
    line = lambda oid, kind, value: s.select("device", F.concat(F.lit(f".{oid}."), key(), F.lit(f" = {kind}: "), value).alias("line"))
    rows = line("1.3.6.1.2.1.31.1.1.1.1", "STRING", F.concat(F.lit('"Gi'), key(), F.lit('"'))).union(line("1.3.6.1.2.1.31.1.1.1.15", "Gauge32", (key() % 40).cast("string"))).union(line("1.3.6.1.2.1.2.2.1.8", "INTEGER", F.concat(F.lit("x("), key() % 3, F.lit(")")))).union(line("1.3.6.1.2.1.2.2.1.8", "INTEGER", (key() % 3).cast("string")))
    found = snmp.interfaces(snmp.parse_lines(rows).where("value not like 'x%'"))
    return found.select("device", "ifindex", "name", "speed_mbps", "oper_status")


@query("learned_macs", """
WITH c AS (SELECT 'd' || c_nationkey AS device, c_custkey % 100 AS m, c_custkey % 8 AS port, c_custkey AS ord FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY device, m ORDER BY ord, port) AS k FROM c)
SELECT device, 'Gi' || port AS interface, '00:00:00:00:01:' || lpad(lower(to_hex(m)), 2, '0') AS mac FROM r WHERE k = 1""")  # fmt: skip
def learned_macs(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.concat(F.lit("d"), "c_nationkey").alias("device"), F.concat(F.lit("0.0.0.0.1."), F.col("c_custkey") % 100).alias("index"), (F.col("c_custkey") % 8).alias("port"), F.col("c_custkey").alias("ord"))
    ports = c.select("device", "port", F.concat(F.lit("Gi"), "port").alias("interface")).distinct()
    return snmp.learned_macs(c, ports)


@query("walk_vlans", """
SELECT 'd' || s_nationkey AS device, s_suppkey AS vid, 'v' || s_suppkey AS name FROM supplier WHERE s_suppkey BETWEEN 1 AND 4094 AND s_suppkey NOT BETWEEN 1002 AND 1005 AND s_nationkey % 2 = 0
UNION ALL SELECT 'd' || s_nationkey, s_suppkey, 'q' || s_suppkey FROM supplier WHERE s_suppkey BETWEEN 1 AND 4094 AND s_suppkey NOT BETWEEN 1002 AND 1005 AND s_nationkey % 2 = 1""")  # fmt: skip
def walk_vlans(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    rows = lambda d, mark: d.select(F.concat(F.lit("d"), "s_nationkey").alias("device"), key().alias("vid"), F.concat(F.lit(mark), key()).alias("name"))
    return snmp.vlans(rows(s.where("s_nationkey % 2 = 0"), "v"), rows(s, "q"))


@query("poll_coverage", """
WITH p AS (SELECT 'd' || s_nationkey AS device, s_suppkey AS k, s_suppkey % 2 = 0 AS required, CASE WHEN s_suppkey % 5 = 0 THEN 'restricted' WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'ok' END AS status FROM supplier),
c AS (SELECT device, CASE WHEN bool_or(required AND status = 'restricted') THEN 'restricted' WHEN bool_or(required AND status <> 'ok') THEN 'partial' ELSE 'full' END AS snmp_health,
  coalesce(string_agg('f' || k, ',' ORDER BY 'f' || k) FILTER (required AND status <> 'ok'), '') AS missing, coalesce(string_agg('f' || k, ',' ORDER BY 'f' || k) FILTER (status = 'restricted'), '') AS restricted FROM p GROUP BY device)
SELECT 'd' || n AS device, coalesce(snmp_health, 'unreachable') AS snmp_health, coalesce(missing, '') AS missing_required, coalesce(restricted, '') AS restricted
FROM (SELECT n_nationkey AS n FROM nation UNION ALL SELECT -1) LEFT JOIN c ON device = 'd' || n""")  # fmt: skip
def poll_coverage(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(key() % 5 == 0, "restricted").when(key() % 3 == 0, "missing").otherwise("ok")
    probes = table(spark, folder, "supplier").select(F.concat(F.lit("d"), "s_nationkey").alias("device"), F.concat(F.lit("f"), key()).alias("family"), status.alias("status"), (key() % 2 == 0).alias("required"))
    every = table(spark, folder, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("device")).union(spark.range(1).select(F.lit("d-1")))
    return snmp.coverage(probes, every).select("device", "snmp_health", *(F.array_join(c, ",").alias(c) for c in ("missing_required", "restricted")))


@query("poll_targets", """
SELECT '10.0.0.' || s_suppkey AS ip, 's' || s_suppkey AS id FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey < 200""")  # fmt: skip
def poll_targets(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").where("s_suppkey < 200")
    ip = F.concat(F.lit("10.0.0."), key())
    failed = s.where("s_suppkey % 4 = 0").select(ip.alias("ip"), F.lit(1000).alias("at"))
    return snmp.targets(s.select(F.concat(F.lit("s"), key()).alias("id"), ip.alias("mgmt_ip"), F.array(F.lit("127.0.0.1")).alias("candidate_ips"), F.lit(True).alias("known_good")), failed, 2000).select("ip", "id")


@query("link_stp", """
SELECT l.s_suppkey AS rid, CASE WHEN l.s_suppkey % 2 = 0 THEN 'forwarding' END AS stp_state_a FROM supplier l""")  # fmt: skip
def link_stp(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    rows = s.select(key().alias("rid"), F.concat(F.lit("s"), key()).alias("src"), F.lit("x").alias("dst"), F.lit("Te1/1").alias("interface_a"), F.lit("Te1/2").alias("interface_b"))
    ports = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), key()).alias("device"), F.lit("tengigabitethernet1/1").alias("interface"), F.lit("forwarding").alias("state"), F.lit("root").alias("role"), F.lit("r").alias("root"), F.lit(1).alias("vlan"))
    return cables.with_stp(rows, ports).select("rid", "stp_state_a")


@query("element_history", """
SELECT user_id AS element, epoch_us(ts) // 1000 AS at, event_type AS state FROM events WHERE user_id = 3""")  # fmt: skip
def element_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("element"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("state"))
    return report.history_of(3, rows.where("element < 0"), rows)


@query("parsed_history", """
SELECT s_suppkey AS k, '[[' || s_suppkey || ',"down"],[' || (s_suppkey + 5) || ',"up"]]' AS history FROM supplier""")  # fmt: skip
def parsed_history(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("[["), key() + 5, F.lit(',"up"],['), key(), F.lit(',"down"]]'))
    return table(spark, folder, "supplier").select(key().alias("k"), timeseries.serialize_history(timeseries.parse_history(raw)).alias("history"))


@query("vlan_evidence", """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), v AS (SELECT DISTINCT n, k % 5 + 1 AS vid FROM s),
e AS (SELECT v.n, v.vid, k, 'tag' AS via FROM v JOIN s ON v.vid = k % 5 + 1 UNION ALL SELECT n, k % 5 + 1, k, 'svi' FROM s
  UNION ALL SELECT v.n, v.vid, k, 'route' FROM v JOIN s ON v.n = s.n AND v.vid = (k + 1) % 5 + 1 UNION ALL SELECT v.n, v.vid, k, 'ipam' FROM v JOIN s ON v.n = s.n AND v.vid = (k + 2) % 5 + 1)
SELECT 'vlan:nb:n' || n || ':' || vid AS vlan, 'p' || k AS prefix, bool_or(via = 'tag') AS via_tag, bool_or(via = 'svi') AS via_svi, bool_or(via = 'route') AS via_routes_to, bool_or(via = 'ipam') AS via_ipam FROM e GROUP BY ALL""")  # fmt: skip
def vlan_evidence_(spark: SparkSession, folder: str) -> DataFrame:
    k, slug = key(), F.concat(F.lit("n"), "s_nationkey")
    s = table(spark, folder, "supplier")
    id_ = lambda mark: F.concat(F.lit(mark), k)
    vlans = s.select(F.concat(F.lit("vlan:nb:"), slug, F.lit(":"), k % 5 + 1).alias("id"), (k % 5 + 1).alias("vid"), slug.alias("slug"), F.array().cast("array<string>").alias("sites")).distinct()
    prefixes = s.select(id_("p").alias("id"), id_("10.").alias("cidr"), (k % 5 + 1).alias("vid"), F.lit(None).cast("string").alias("network_id"), ((k + 2) % 5 + 1).alias("ipam_vid"), F.when(k % 2 == 0, slug).alias("ipam_site"))
    routes = s.select(id_("s").alias("device"), F.concat(F.lit("Vl"), (k + 1) % 5 + 1).alias("interface"), id_("p").alias("prefix"))
    located = s.select(id_("s").alias("device"), slug.alias("site"))
    ports = s.select(id_("i").alias("id"), id_("s").alias("device"), F.concat(F.lit("Vlan "), k % 5 + 1).alias("name"))
    return vlan_evidence.link(vlans, s.select(id_("s").alias("id"), slug.alias("slug")), located, ports, s.select(id_("i").alias("interface"), id_("10.").alias("subnet")), prefixes, routes)[1]


@query("stp_edges", """
WITH b AS (SELECT s_suppkey AS k, s_nationkey AS n, CASE WHEN s_nationkey % 5 = 0 THEN 'stp:s' || s_suppkey || ':default' ELSE 'stp-domain:00:00:00:00:00:' || lpad(lower(to_hex(s_nationkey)), 2, '0') END AS d FROM supplier)
SELECT 'STP_MEMBER' AS type, 's' || k AS src, d AS dst, CAST(k % 8 * 4096 AS INTEGER) AS priority, NULL AS state, NULL AS role FROM b UNION ALL SELECT 'STP_ROOT', 's' || k, d, CAST(k % 8 * 4096 AS INTEGER), NULL, NULL FROM b WHERE k % 3 = 0
UNION ALL SELECT 'STP_LINK', 'snmp-if:s' || k || CASE WHEN k % 2 = 0 THEN ':Gi' || k ELSE ':port-' || k END, d, NULL, 'forwarding', 'unknown' FROM b WHERE k % 4 > 0""")  # fmt: skip
def stp_edges(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").withColumn("device", F.concat(F.lit("s"), key()))
    root = F.when(F.col("s_nationkey") % 5 > 0, F.lpad(F.hex("s_nationkey"), 12, "0"))
    ports = s.select("device", key().cast("string").alias("port"), F.when(key() % 2 == 0, F.concat(F.lit("Gi"), key())).alias("interface"), F.when(key() % 4 == 0, "disabled").otherwise("forwarding").alias("state"), F.lit(None).cast("string").alias("role"))
    return snmp.stp_edges(s.select("device", root.alias("root_mac"), (key() % 3).alias("root_port"), (key() % 8 * 4096).alias("priority")), ports)


@query("poll_results", """
SELECT 's' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'cloud_ok' ELSE 'unreachable' END END AS status,
  CASE s_suppkey % 4 WHEN 0 THEN 'cloud,direct' WHEN 1 THEN 'cloud,direct' WHEN 2 THEN 'cloud' ELSE 'direct,cloud' END AS sources FROM supplier""")  # fmt: skip
def poll_results(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    ip = F.concat(F.lit("10.0.0."), key())
    known = s.select(F.concat(F.lit("s"), key()).alias("id"), ip.alias("mgmt_ip"), (key() % 3 == 0).alias("snmp_cloud"), F.array(F.lit("direct"), F.lit("cloud")).alias("snmp_sources"))
    targets = s.where("s_suppkey % 4 < 3").select(F.when(key() % 4 == 0, F.concat(F.lit("s"), key())).otherwise(F.concat(F.lit("t"), key())).alias("node_id"), F.when(key() % 4 > 0, ip).otherwise("x").alias("ip"), (key() % 4 < 2).alias("ok"))
    return snmp.polled(known, targets).select("id", F.col("snmp_last_status").alias("status"), F.array_join("snmp_sources", ",").alias("sources"))


@query("undiscovered_targets", """
SELECT 't' || s_suppkey AS id, '10.0.0.' || s_suppkey AS name, '10.0.0.' || s_suppkey AS mgmt_ip FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 2 = 0""")  # fmt: skip
def undiscovered_targets(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    ip = F.concat(F.lit("10.0.0."), key())
    targets = s.select(F.concat(F.lit("t"), key()).alias("node_id"), ip.alias("ip"), F.lit(None).cast("string").alias("name"), (key() % 2 == 0).alias("ok"))
    return snmp.undiscovered(targets, s.where("s_suppkey % 3 <> 1").select(ip.alias("mgmt_ip")))


@query("mac_vendors", """
SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'Acme' END AS vendor FROM supplier""")  # fmt: skip
def mac_vendors(spark: SparkSession, folder: str) -> DataFrame:
    address = F.when(key() % 3 == 0, "0050.f200.0001").when(key() % 3 == 1, "02:50:f2:00:00:01").otherwise("aa")
    known = spark.createDataFrame([("0050f2", "Acme"), ("0250F2", "Local"), ("0050F2", "Zeta")], "prefix string, vendor string")
    return snmp.vendors(table(spark, folder, "supplier").select(key().alias("k"), address.alias("mac")), known).select("k", "vendor")


@query("device_addresses", """
SELECT 's' || s_suppkey AS device, CASE WHEN s_suppkey % 2 = 0 THEN '10.0.' || s_suppkey % 250 || '.9' ELSE '2001:db8::' || s_suppkey % 9 || ':1' END AS ip, CASE WHEN s_suppkey % 2 = 0 THEN 4 ELSE 6 END AS version,
  CASE WHEN s_suppkey % 2 = 0 THEN '10.0.' || s_suppkey % 250 || '.0/24' ELSE '2001:db8::/64' END AS prefix FROM supplier""")  # fmt: skip
def device_addresses(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    ip = F.when(key() % 2 == 0, F.concat(F.lit("10.0."), key() % 250, F.lit(".9"))).otherwise(F.concat(F.lit("2001:db8::"), key() % 9, F.lit(":1")))
    rows = s.select(F.concat(F.lit("s"), key()).alias("device"), ip.alias("ip"), F.lit(None).cast("int").alias("prefix_len"))
    return snmp.addresses(rows.where("device like '%0'"), rows).select("device", "ip", "version", "prefix")


@query("local_addresses", """
SELECT c_custkey AS peer, CASE WHEN c_custkey % 3 = 0 THEN '10.0.' || s_suppkey % 250 || '.1' ELSE 'mgmt' || s_suppkey END AS local_ip FROM customer JOIN supplier ON s_suppkey = c_custkey % 50""")  # fmt: skip
def local_addresses(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").withColumn("device", F.concat(F.lit("s"), key()))
    own = s.select("device", F.explode(F.array(F.concat(F.lit("10.0."), key() % 250, F.lit(".1")), F.concat(F.lit("10.0."), key() % 250, F.lit(".2")))).alias("ip"))
    c = F.col("c_custkey")
    peers = table(spark, folder, "customer").select(c.alias("peer"), F.concat(F.lit("s"), c % 50).alias("device"), F.when(c % 3 == 0, F.concat(F.lit("10.0."), c % 50, F.lit(".77"))).otherwise("192.168.0.1").alias("peer_ip"))
    found = decorate.local_address(peers.join(s.select("device"), "device", "left_semi"), own, s.select("device", F.concat(F.lit("mgmt"), key()).alias("mgmt_ip")))
    return found.select("peer", "local_ip")
