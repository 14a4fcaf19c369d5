"""Queries of lists, tables and small corrections of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import decorate, housekeeping, links as L, reconcile, report, resolve, snmp, store
from netloom.plans.catalog import query
from netloom.plans.graph import DEVICES, LINES, LINKS, devices, lines, links, table


def _k(column: str = "s_suppkey") -> Column:
    return F.col(column)


def _id(mark: str, column: str | Column) -> Column:
    return F.concat(F.lit(mark), column)


@query("inventory_list", f"""
WITH {DEVICES} SELECT id, name, status FROM devices WHERE lower(role) = 'building' AND status = 'active' ORDER BY name, id LIMIT 300""")  # fmt: skip
def inventory_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = devices(spark, folder).withColumns({"site": F.col("nation").cast("string"), "flap_state": F.lit(None).cast("string")})
    return report.inventory_list(rows, role="Building", status="ACTIVE", limit=300).select("id", "name", "status")


_MACS = f"{LINES}, macs AS (SELECT src, dst, 'Gi' || l_linenumber AS interface, '02:00:00:00:' || lpad(lower(to_hex(l_partkey % 4096 // 256)), 2, '0') || ':' || lpad(lower(to_hex(l_partkey % 256)), 2, '0') AS mac, l_orderkey % 50 AS ip, l_linenumber AS n FROM lines)"


def _macs(spark: SparkSession, folder: str) -> DataFrame:
    low = F.col("l_partkey") % 4096
    digits = F.concat(F.lit("02000000"), F.lpad(F.hex(F.floor(low / 256)), 2, "0"), F.lpad(F.hex(low % 256), 2, "0"))
    text = F.array_join(F.regexp_extract_all(F.lower(digits), F.lit("(..)"), 1), ":")
    return lines(spark, folder).select("src", "dst", _id("Gi", "l_linenumber").alias("interface"), text.alias("mac"), (F.col("l_orderkey") % 50).alias("ip"), F.col("l_linenumber").alias("n"))


def _cam(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _macs(spark, folder)
    return rows.where("n % 2 = 1").select("mac", F.col("src").alias("device"), "interface"), rows.where("n % 2 = 0").select("mac", F.col("dst").alias("device")), rows.select("mac", "ip")


@query("mac_table", f"""
WITH {_MACS} SELECT src AS device, interface, mac FROM macs WHERE n % 2 = 1 AND mac = '02:00:00:00:00:2a' ORDER BY device, interface, mac LIMIT 500""")  # fmt: skip
def mac_table(spark: SparkSession, folder: str) -> DataFrame:
    return report.mac_table(_cam(spark, folder)[0], address="0200.0000.002A").select("device", "interface", "mac")


@query("mac_lookup", f"""
WITH {_MACS}, m AS (SELECT * FROM macs WHERE mac = '02:00:00:00:00:2a'), l AS (SELECT mac, min((src, interface)) AS p FROM m WHERE n % 2 = 1 GROUP BY mac), o AS (SELECT mac, min(dst) AS owner FROM m WHERE n % 2 = 0 GROUP BY mac)
SELECT b.mac, p[1] AS switch, p[2] AS interface, owner, array_to_string(list_sort(list(DISTINCT b.ip)), ',') AS ips, CASE WHEN p IS NOT NULL THEN 'learned' WHEN owner IS NOT NULL THEN 'owned' ELSE 'arp' END AS source
FROM m b LEFT JOIN l ON l.mac = b.mac LEFT JOIN o ON o.mac = b.mac GROUP BY b.mac, p, owner""")  # fmt: skip
def mac_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return report.mac_lookup(*_cam(spark, folder), "02-00-00-00-00-2A").select("mac", "switch", "interface", "owner", F.array_join(F.col("ips").cast("array<string>"), ",").alias("ips"), "source")


@query("vlan_members", f"""
WITH {LINES} SELECT DISTINCT src AS device, l_partkey % 30 AS vid FROM lines WHERE l_partkey % 30 = 7""")  # fmt: skip
def vlan_members(spark: SparkSession, folder: str) -> DataFrame:
    return report.vlan_members(lines(spark, folder).select(F.col("src").alias("device"), (F.col("l_partkey") % 30).alias("vid")), 7)


_TYPED = f"{LINES}, typed AS (SELECT src, dst, CASE WHEN l_partkey % 9 = 0 THEN 'PHYSICAL_LINK' ELSE 'ROUTING_PEER' END AS type FROM lines)"


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).select("src", "dst", F.when(F.col("l_partkey") % 9 == 0, "PHYSICAL_LINK").otherwise("ROUTING_PEER").alias("type"))


@query("collapsed_l3", f"""
WITH {_TYPED}, cabled AS (SELECT DISTINCT src, dst FROM typed WHERE type = 'PHYSICAL_LINK')
SELECT DISTINCT t.src, t.dst, t.type FROM typed t LEFT JOIN cabled c ON c.src = t.src AND c.dst = t.dst WHERE c.src IS NULL OR t.type = 'PHYSICAL_LINK'""")  # fmt: skip
def collapsed_l3(spark: SparkSession, folder: str) -> DataFrame:
    return report.collapse_l3(_typed(spark, folder))


@query("capped_graph", f"""
WITH {DEVICES}, {_TYPED}, few AS (SELECT id FROM devices ORDER BY id LIMIT 400)
SELECT id AS item, NULL AS type FROM few UNION ALL SELECT DISTINCT src || ' ' || dst, type FROM typed WHERE src IN (SELECT id FROM few) AND dst IN (SELECT id FROM few)""")  # fmt: skip
def capped_graph(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = report.capped(devices(spark, folder), _typed(spark, folder).distinct(), 400)
    return nodes.select(F.col("id").alias("item"), F.lit(None).cast("string").alias("type")).union(edges.select(F.concat_ws(" ", "src", "dst"), "type"))


_DOMAINS = f"""{LINES}, members AS (
  SELECT DISTINCT src AS device, 'd' || (l_partkey % 60) AS domain, CASE WHEN l_partkey % 60 % 3 > 0 THEN 'vlan ' || (l_partkey % 60) END AS name, l_partkey % 60 % 17 = 0 AS is_root, CASE WHEN l_partkey % 60 % 4 > 0 THEN l_partkey % 60 % 5 * 4096 END AS priority FROM lines)"""


def _domains(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("l_partkey") % 60
    return lines(spark, folder).select(F.col("src").alias("device"), _id("d", d).alias("domain"), F.when(d % 3 > 0, _id("vlan ", d)).alias("name"), (d % 17 == 0).alias("is_root"), F.when(d % 4 > 0, d % 5 * 4096).alias("priority")).distinct()


@query("device_domains", f"""
WITH {_DOMAINS}, r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY is_root DESC, coalesce(priority, 32768), name IS NULL, domain) AS k FROM members) SELECT device, domain FROM r WHERE k = 1""")  # fmt: skip
def device_domains(spark: SparkSession, folder: str) -> DataFrame:
    return decorate.device_domains(_domains(spark, folder)).select("device", "domain")


@query("merged_domains", f"""
WITH {_DOMAINS}, named AS (SELECT device, min(domain) AS into_ FROM members WHERE name IS NOT NULL AND is_root GROUP BY device)
SELECT domain, min(into_) AS "into" FROM members JOIN named USING (device) WHERE name IS NULL AND is_root GROUP BY domain""")  # fmt: skip
def merged_domains(spark: SparkSession, folder: str) -> DataFrame:
    return decorate.merge_domains(_domains(spark, folder).where("is_root"))


@query("site_vlans", f"""
WITH {DEVICES}, v AS (SELECT DISTINCT n_regionkey * 10 + n_nationkey % 4 AS vlan, n_nationkey AS site FROM nation), m AS (SELECT id, nation * 3 AS vlan FROM devices)
SELECT d.id AS device, v.vlan FROM devices d JOIN v ON v.site = d.nation WHERE d.status = 'active' AND NOT EXISTS (SELECT 1 FROM m WHERE m.id = d.id AND m.vlan = v.vlan)""")  # fmt: skip
def site_vlans(spark: SparkSession, folder: str) -> DataFrame:
    own = devices(spark, folder)
    vlans = table(spark, folder, "nation").select((F.col("n_regionkey") * 10 + F.col("n_nationkey") % 4).alias("vlan"), F.col("n_nationkey").alias("site"))
    return decorate.site_vlans(own.select(F.col("id").alias("device"), F.col("nation").alias("site"), (F.col("status") == "active").alias("live")), vlans, own.select(F.col("id").alias("device"), (F.col("nation") * 3).alias("vlan")))


@query("vlan_labels", """
WITH p AS (SELECT p_partkey % 40 AS vlan, CASE WHEN p_partkey % 3 = 0 THEN '2001:db8:' || p_partkey % 70 || '::/64' ELSE '10.0.' || p_partkey % 90 || '.0/24' END AS prefix FROM part)
SELECT vlan, array_to_string(list_sort(list(DISTINCT prefix) FILTER (prefix NOT LIKE '%:%')), ',') AS prefix_v4, array_to_string(list_sort(list(DISTINCT prefix) FILTER (prefix LIKE '%:%')), ',') AS prefix_v6 FROM p GROUP BY vlan""")  # fmt: skip
def vlan_labels(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_partkey")
    prefix = F.when(p % 3 == 0, F.concat(F.lit("2001:db8:"), p % 70, F.lit("::/64"))).otherwise(F.concat(F.lit("10.0."), p % 90, F.lit(".0/24")))
    return decorate.vlan_labels(table(spark, folder, "part").select((p % 40).alias("vlan"), prefix.alias("prefix"))).select("vlan", *(F.array_join(c, ",").alias(c) for c in ("prefix_v4", "prefix_v6")))


@query("rehomed", """
SELECT 'o' || l_orderkey AS id, min(s_nationkey % 3) AS site FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey HAVING count(DISTINCT s_nationkey % 3) = 1""")  # fmt: skip
def rehomed(spark: SparkSession, folder: str) -> DataFrame:
    """Orders all of whose suppliers are at one site."""
    rows = table(spark, folder, "lineitem").select(_id("o", "l_orderkey").alias("id"), _id("s", "l_suppkey").alias("other"))
    return resolve.rehome(rows.select("id").distinct(), rows, table(spark, folder, "supplier").select(_id("s", _k()).alias("id"), (F.col("s_nationkey") % 3).alias("site")))


@query("tombstones", f"""
WITH {DEVICES}, m AS (SELECT 'c' || c_custkey AS stub, 's' || (c_custkey % 10 + 1) AS canonical FROM customer WHERE c_acctbal < 500)
SELECT id, canonical AS canonical_id, canonical IS NOT NULL AS tombstoned FROM devices LEFT JOIN m ON stub = id""")  # fmt: skip
def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    mapping = table(spark, folder, "customer").where("c_acctbal < 500").select(_id("c", "c_custkey").alias("stub"), _id("s", F.col("c_custkey") % 10 + 1).alias("canonical"))
    return resolve.tombstoned(devices(spark, folder).withColumn("canonical_id", F.lit(None).cast("string")), mapping).select("id", "canonical_id", "tombstoned")


@query("normalised_links", f"""
WITH {LINKS} SELECT rid, 'GigabitEthernet' || substr(interface_a, 3) AS interface_a, 'Ethernet' || substr(interface_b, 4) AS interface_b FROM links""")  # fmt: skip
def normalised_links(spark: SparkSession, folder: str) -> DataFrame:
    return L.normalised(links(spark, folder)).select("rid", "interface_a", "interface_b")


@query("management_ips", """
SELECT s_suppkey AS k, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'vlan' END, CASE WHEN s_suppkey % 5 = 0 THEN 'vpn' END, CASE WHEN s_suppkey % 7 > 0 THEN 'wan1' END) ELSE CASE WHEN s_suppkey % 7 > 0 THEN 'wan1' END END, CASE WHEN s_suppkey % 11 > 0 THEN 'first' END) AS ip FROM supplier""")  # fmt: skip
def management_ips(spark: SparkSession, folder: str) -> DataFrame:
    blank = lambda n, word: F.when(_k() % n == 0, word).otherwise("")
    wan = F.when(_k() % 7 > 0, "wan1")
    ip = housekeeping.management_ip(_k() % 2 == 0, blank(3, "vlan"), blank(5, "vpn"), wan, F.lit(None).cast("string"), F.when(_k() % 11 > 0, F.array(F.lit("first"), F.lit("second"))))
    return table(spark, folder, "supplier").select(_k().alias("k"), ip.alias("ip"))


@query("enriched_prefixes", """
WITH ipam AS (SELECT 'p' || p_partkey % 300 AS prefix, min((p_size, p_brand)) AS x FROM part GROUP BY 1)
SELECT DISTINCT 'p' || l_partkey AS prefix, x[1] AS ipam_vid, x[2] AS ipam_site FROM lineitem LEFT JOIN ipam ON ipam.prefix = 'p' || l_partkey""")  # fmt: skip
def enriched_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    """Prefixes named by their network or by their older field."""
    name = _id("p", "l_partkey")
    rows = table(spark, folder, "lineitem").select(F.when(F.col("l_partkey") % 2 == 0, name).alias("cidr"), F.when(F.col("l_partkey") % 2 == 1, name).alias("prefix")).distinct()
    ipam = table(spark, folder, "part").select(_id("p", F.col("p_partkey") % 300).alias("prefix"), F.col("p_size").alias("vid"), F.col("p_brand").alias("site"))
    return reconcile.enrich_prefixes(rows, ipam).select(F.coalesce("cidr", "prefix").alias("prefix"), "ipam_vid", "ipam_site")


@query("missing_serials", """
SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 5 > 1""")  # fmt: skip
def missing_serials(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    blank = lambda n: F.when(c % n == 0, F.lit(None).cast("string")).when(c % n == 1, "  ").otherwise(_id("S", c))
    return reconcile.missing_serials(table(spark, folder, "customer").select(c.alias("k"), blank(3).alias("intent_serial"), blank(5).alias("current_serial"))).select("k")


@query("mapping_stats", """
WITH m AS (SELECT 'n' || n_nationkey AS ps, CASE n_regionkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'slug' ELSE 'prefix' END AS method FROM nation WHERE n_nationkey % 4 > 0)
SELECT method, count(*) AS n FROM m GROUP BY method UNION ALL SELECT 'unmatched', count(*) FROM customer WHERE 'n' || c_nationkey NOT IN (SELECT ps FROM m)""")  # fmt: skip
def mapping_stats(spark: SparkSession, folder: str) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, ("exact", "slug", "prefix"))), F.col("n_regionkey") % 3 + 1)
    mapping = table(spark, folder, "nation").where("n_nationkey % 4 > 0").select(_id("n", "n_nationkey").alias("ps"), method.alias("method"))
    return reconcile.mapping_stats(mapping, table(spark, folder, "customer").select(_id("n", "c_nationkey").alias("ps")))


@query("filled_sites", f"""
WITH {DEVICES} SELECT id, CASE WHEN balance > 3000 THEN 'own' || nation WHEN nation % 5 > 0 THEN 'map' || nation END AS site FROM devices""")  # fmt: skip
def filled_sites(spark: SparkSession, folder: str) -> DataFrame:
    nodes = devices(spark, folder).select("id", F.col("nation").alias("network"), F.when(F.col("balance") > 3000, _id("own", "nation")).alias("site"))
    mapping = table(spark, folder, "nation").where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("network"), _id("map", "n_nationkey").alias("site"))
    return reconcile.fill_sites(nodes, mapping).select("id", "site")


@query("external_routers", """
WITH p AS (SELECT 's' || s_suppkey AS device, '192.0.2.' || s_nationkey AS ip, CASE s_suppkey % 4 WHEN 0 THEN 3356 WHEN 1 THEN 65001 WHEN 2 THEN 701 ELSE 7018 END AS asn FROM supplier), f AS (SELECT *, 'ext-router:' || asn || ':' || ip AS id FROM p WHERE asn IN (3356, 7018))
SELECT DISTINCT device AS src, id AS dst, 'WAN_UPLINK' AS type FROM f UNION ALL SELECT DISTINCT id, 'internet:0', 'TRANSITS' FROM f""")  # fmt: skip
def external_routers(spark: SparkSession, folder: str) -> DataFrame:
    asn = F.element_at(F.array(*map(F.lit, (3356, 65001, 701, 7018))), (_k() % 4 + 1).cast("int"))
    return decorate.external_routers(table(spark, folder, "supplier").select(_id("s", _k()).alias("device"), _id("192.0.2.", "s_nationkey").alias("peer_ip"), asn.alias("remote_as")), 701)[1]


@query("ospf_peers", """
WITH p AS (SELECT 'd' || s_nationkey % 3 AS device, CASE WHEN s_suppkey % 9 = 0 THEN '127.0.0.1' ELSE '10.0.' || s_suppkey // 200 || '.' || lpad((s_suppkey % 200)::VARCHAR, 3, '1') END AS ip,
  ['unknown', 'down', 'attempt', 'init', 'twoWay', 'exchangeStart', 'exchange', 'loading', 'full', 'unknown'][s_suppkey % 10 + 1] AS state FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY ip) AS k FROM p WHERE ip <> '127.0.0.1') SELECT device, ip AS peer_ip, state FROM r WHERE k <= 20""")  # fmt: skip
def ospf_peers(spark: SparkSession, folder: str) -> DataFrame:
    ip = F.when(_k() % 9 == 0, "127.0.0.1").otherwise(F.concat(F.lit("10.0."), F.floor(_k() / 200), F.lit("."), F.lpad((_k() % 200).cast("string"), 3, "1")))
    rows = table(spark, folder, "supplier").select(_id("d", F.col("s_nationkey") % 3).alias("device"), ip.alias("peer_ip"), (_k() % 10).alias("state"))
    return snmp.peers(rows, snmp.OSPF, most=20)


@query("arp_bindings", """
SELECT DISTINCT '10.1.' || c_nationkey || '.' || c_custkey % 200 AS ip, '02:00:00:00:00:' || lpad(lower(to_hex(c_custkey % 100)), 2, '0') AS mac FROM customer WHERE c_custkey % 6 > 0""")  # fmt: skip
def arp_bindings(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    address = F.when(c % 6 > 0, F.concat(F.lit("0200.0000.00"), F.lpad(F.hex(c % 100), 2, "0"))).otherwise("incomplete")
    return snmp.arp_entries(table(spark, folder, "customer").select(F.lit("d").alias("device"), F.concat(F.lit("10.1."), "c_nationkey", F.lit("."), c % 200).alias("ip"), address.alias("mac"))).select("ip", "mac")


_PORTS = """p AS (SELECT 's' || s_suppkey AS device, 'Gi' || s_nationkey AS interface, CASE WHEN s_suppkey % 3 > 0 THEN 'trunk' ELSE 'access' END AS mode, CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey % 90 + 1 END AS access FROM supplier),
m AS (SELECT DISTINCT 's' || l_suppkey AS device, l_partkey % 60 + 990 AS vid FROM lineitem), v AS (SELECT device, list_sort(list(vid)) AS vids FROM m WHERE vid NOT BETWEEN 1002 AND 1005 GROUP BY device),
q AS (SELECT p.*, CASE WHEN mode = 'trunk' THEN vids END AS allowed, CASE WHEN mode <> 'trunk' THEN coalesce(access, vids[1]) END AS one FROM p LEFT JOIN v USING (device))"""


def _ports(spark: SparkSession, folder: str) -> DataFrame:
    ports = table(spark, folder, "supplier").select(_id("s", _k()).alias("device"), _id("Gi", "s_nationkey").alias("interface"), F.when(_k() % 3 > 0, "trunk").otherwise("access").alias("trunk_mode"), F.lit(1).alias("native"), F.when(_k() % 6 == 0, _k() % 90 + 1).alias("access"))
    members = table(spark, folder, "lineitem").select(_id("s", "l_suppkey").alias("device"), (F.col("l_partkey") % 60 + 990).alias("vid")).distinct().join(ports.select("device", "interface"), "device")
    return snmp.port_vlans(ports, members)


@query("port_vlans", f"""
WITH {_PORTS} SELECT device, interface, array_to_string(allowed, ',') AS allowed, one AS access FROM q""")  # fmt: skip
def port_vlans(spark: SparkSession, folder: str) -> DataFrame:
    return _ports(spark, folder).select("device", "interface", F.array_join(F.col("vlans_allowed").cast("array<string>"), ",").alias("allowed"), F.col("vlans_access").alias("access"))


@query("stp_contexts", f"""
WITH {_PORTS}, e AS (SELECT device, unnest(coalesce(allowed, [one])) AS vid FROM q) SELECT device, array_to_string(list_sort(list(DISTINCT vid))[1:25], ',') AS vlans FROM e WHERE vid BETWEEN 1 AND 4094 AND vid NOT BETWEEN 1002 AND 1005 GROUP BY device""")  # fmt: skip
def stp_contexts(spark: SparkSession, folder: str) -> DataFrame:
    return snmp.stp_contexts(_ports(spark, folder), 25).select("device", F.array_join(F.col("vlans").cast("array<string>"), ",").alias("vlans"))


@query("merged_snapshots", """
SELECT 'c' || c_custkey AS id, c_name AS name, NULL AS nation FROM customer UNION ALL SELECT 's' || s_suppkey, NULL, s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, n_nationkey FROM nation""")  # fmt: skip
def merged_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots with different columns."""
    c = table(spark, folder, "customer").select(_id("c", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, folder, "supplier").select(_id("s", _k()).alias("id"), F.col("s_nationkey").alias("nation"))
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("nation"), _id("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return store.merge(c, s, n).select("id", "name", "nation")
