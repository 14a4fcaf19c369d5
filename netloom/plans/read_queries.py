"""Queries of the read operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import decorate, housekeeping, report
from netloom.plans.catalog import query
from netloom.plans.graph import DEVICES, LINES, LINKS, devices, lines, links, table

_TYPES = ["Device", "PlatformSite", "Site", "VLAN", "Internet"]


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    node = lambda d, key, kind: d.select(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"))
    out = devices(spark, folder).select("id", F.lit("Device").alias("type"))
    for name, key, kind in (("nation", "n_nationkey", "PlatformSite"), ("region", "r_regionkey", "Site"), ("part", "p_partkey", "VLAN")):
        out = out.union(node(table(spark, folder, name), key, kind))
    return out


@query("graph_stats", """
SELECT 'Device' AS type, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'PlatformSite', (SELECT count(*) FROM nation) UNION ALL SELECT 'Site', (SELECT count(*) FROM region) UNION ALL SELECT 'VLAN', (SELECT count(*) FROM part) UNION ALL SELECT 'Internet', 0""")  # fmt: skip
def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    return report.counts_by_type(_nodes(spark, folder), _TYPES)


@query("correlation_provenance", f"WITH {LINKS} SELECT proto AS origin, count(*) AS n FROM links GROUP BY 1")
def correlation_provenance(spark: SparkSession, folder: str) -> DataFrame:
    return report.provenance(links(spark, folder).withColumn("source", F.lit(None).cast("string")))


@query("aggregated_topology", f"""
WITH {LINKS}, {DEVICES}, x AS (SELECT least(a.nation, b.nation) AS a, greatest(a.nation, b.nation) AS b FROM links l JOIN devices a ON a.id = l.src JOIN devices b ON b.id = l.dst WHERE a.nation <> b.nation)
SELECT a, b, count(*) AS links FROM x GROUP BY a, b""")  # fmt: skip
def aggregated_topology(spark: SparkSession, folder: str) -> DataFrame:
    return report.aggregated(devices(spark, folder), links(spark, folder), "nation")[1]


@query("aggregated_sites", f"""
WITH {DEVICES} SELECT nation, count(*) AS devices, count(*) FILTER (status IN ('down', 'alerting')) AS down, array_to_string(list_sort(list(DISTINCT name))[1:10], ',') AS sample FROM devices GROUP BY nation""")  # fmt: skip
def aggregated_sites(spark: SparkSession, folder: str) -> DataFrame:
    return report.aggregated(devices(spark, folder), links(spark, folder), "nation")[0].withColumn("sample", F.array_join("sample", ","))


@query("inventory", f"""
WITH {DEVICES} SELECT id, name, role, nation AS site, CASE WHEN balance > 5000 THEN 'full' WHEN balance > 0 THEN 'unpolled' ELSE 'cloud_only' END AS snmp_health, CASE WHEN balance > 5000 THEN source_adapter || ',snmp' ELSE source_adapter END AS sources FROM devices WHERE NOT (source_adapter = 's' AND nation = 3)""")  # fmt: skip
def inventory(spark: SparkSession, folder: str) -> DataFrame:
    d = devices(spark, folder)
    rows = d.withColumns({"stub": (F.col("source_adapter") == "s") & (F.col("nation") == 3), "snmp_health": F.lit(None).cast("string"), "snmp_polled": F.col("balance") > 5000, "mgmt_ip": F.when(F.col("balance") > 0, "10.0.0.1")})
    located = d.select("id", F.col("nation").alias("site")).union(d.select("id", F.col("nation") + 100))
    return report.inventory(rows, located).select("id", "name", "role", "site", "snmp_health", F.array_join("data_sources", ",").alias("sources"))


@query("filter_catalog", f"""
WITH {DEVICES} SELECT 'site' AS kind, 'n' || n_nationkey AS value FROM nation WHERE n_nationkey < 20 UNION SELECT 'site', 'n' || nation FROM devices WHERE nation > 10 UNION ALL SELECT 'device', min(name) FROM devices GROUP BY lower(name)""")  # fmt: skip
def filter_catalog(spark: SparkSession, folder: str) -> DataFrame:
    sites = table(spark, folder, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("slug"))
    rows = devices(spark, folder).withColumn("site_slug", F.when(F.col("nation") > 10, F.concat(F.lit("n"), "nation")))
    return report.filter_catalog(sites, rows)


@query("cam_correlated", f"""
WITH {LINES}, l AS (SELECT l_partkey AS mac, min(src || '/' || 'Gi' || l_linenumber) AS port FROM lines WHERE l_linenumber % 2 = 1 GROUP BY 1), o AS (SELECT l_partkey AS mac, min(dst) AS owner FROM lines WHERE l_linenumber % 2 = 0 GROUP BY 1),
b AS (SELECT l_partkey AS mac, array_to_string(list_sort(list(DISTINCT l_orderkey % 50)), ',') AS ips FROM lines GROUP BY 1)
SELECT coalesce(l.mac, o.mac, b.mac) AS mac, split_part(port, '/', 1) AS switch, owner, ips, CASE WHEN port IS NOT NULL THEN 'learned' WHEN owner IS NOT NULL THEN 'owned' ELSE 'arp' END AS source FROM l FULL JOIN o ON l.mac = o.mac FULL JOIN b ON b.mac = coalesce(l.mac, o.mac)""")  # fmt: skip
def cam_correlated(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).withColumn("mac", F.col("l_partkey"))
    learned = rows.where("l_linenumber % 2 = 1").select("mac", F.col("src").alias("device"), F.concat(F.lit("Gi"), "l_linenumber").alias("interface"))
    owned = rows.where("l_linenumber % 2 = 0").select("mac", F.col("dst").alias("device"))
    bound = rows.select("mac", (F.col("l_orderkey") % 50).alias("ip"))
    return report.correlated_cam(learned, owned, bound).select("mac", "switch", "owner", F.array_join(F.col("ips").cast("array<string>"), ",").alias("ips"), "source")


_LINK_FACTS = f"""{LINKS}, facts AS (SELECT rid, src || '<->' || dst AS label, CASE WHEN rid % 7 = 0 THEN 'down' ELSE 'up' END AS oper_status, CASE WHEN rid % 11 = 0 THEN 'flapping' WHEN rid % 13 = 0 THEN 'unstable' ELSE 'stable' END AS flap_state,
  confidence * 200 AS util_avg_1h, CASE WHEN rid % 5 = 0 THEN confidence * 10 ELSE 0 END AS error_avg_1h, rid % 6 AS flap_count_1h, CASE WHEN rid % 3 = 0 THEN rid % 1000 END AS changed_at, CAST(confidence * 100 AS INTEGER) AS health_score, src, dst FROM links)"""


def link_facts(spark: SparkSession, folder: str) -> DataFrame:
    r = F.col("rid")
    return links(spark, folder).select(
        "rid", F.concat_ws("<->", "src", "dst").alias("label"), F.when(r % 7 == 0, "down").otherwise("up").alias("oper_status"),
        F.when(r % 11 == 0, "flapping").when(r % 13 == 0, "unstable").otherwise("stable").alias("flap_state"), (F.col("confidence") * 200).alias("util_avg_1h"),
        F.when(r % 5 == 0, F.col("confidence") * 10).otherwise(0.0).alias("error_avg_1h"), (r % 6).alias("flap_count_1h"), F.when(r % 3 == 0, r % 1000).alias("changed_at"),
        F.round(F.col("confidence") * 100).cast("int").alias("health_score"), "src", "dst",
    )


@query("links_list", f"""
WITH {_LINK_FACTS} SELECT rid, flap_count_1h, changed_at, array_to_string(list_filter([75, 85, 95], lambda b: util_avg_1h >= b), ',') AS util_breaches, array_to_string(list_filter([1, 5], lambda b: error_avg_1h >= b), ',') AS error_breaches
FROM facts WHERE util_avg_1h >= 50 ORDER BY flap_count_1h DESC NULLS LAST, changed_at DESC NULLS LAST, health_score DESC NULLS LAST, rid LIMIT 300""")  # fmt: skip
def links_list(spark: SparkSession, folder: str) -> DataFrame:
    from netloom.operators.links import urgency

    rows = report.breaches(urgency(link_facts(spark, folder).where("util_avg_1h >= 50"), 300))
    return rows.select("rid", "flap_count_1h", "changed_at", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("util_breaches", "error_breaches")))


_SEVERITY = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


@query("top_problems", f"""
WITH {_LINK_FACTS}, {DEVICES}, d AS (SELECT *, CASE WHEN source_adapter = 's' THEN 'unreachable' WHEN nation = 5 THEN 'restricted' WHEN nation % 6 = 0 THEN 'unpolled' END AS snmp, CASE WHEN nation % 2 = 0 THEN 0 WHEN nation % 5 > 0 THEN 1000000000 END AS last FROM devices),
s AS (SELECT s_suppkey AS id, s_name AS label, CASE WHEN s_suppkey % 4 = 0 THEN 'down' ELSE 'up' END AS state, CASE WHEN s_suppkey % 9 = 0 THEN 'flapping' END AS flap FROM supplier),
l AS (SELECT facts.*, greatest(a.last, b.last) AS last, CASE WHEN rid % 3 > 0 THEN util_avg_1h ELSE 2 * util_avg_1h END AS use, CASE WHEN rid % 4 > 0 THEN error_avg_1h ELSE 2 * error_avg_1h END AS errors FROM facts JOIN d a ON a.id = src JOIN d b ON b.id = dst),
p AS (SELECT 'device_down' AS problem_type, CASE WHEN 1000000000 - last > 86400000 THEN 'info' ELSE 'critical' END AS severity, name || ' is ' || status AS summary, id AS element FROM d WHERE status IN ('down', 'alerting')
 UNION ALL SELECT 'snmp_unreachable', 'warning', name || ' does not answer', id FROM d WHERE snmp = 'unreachable'
 UNION ALL SELECT 'snmp_restricted', 'warning', name || ' restricts its view', id FROM d WHERE snmp = 'restricted'
 UNION ALL SELECT 'snmp_unpolled', 'info', name || ' is not polled', id FROM d WHERE snmp = 'unpolled'
 UNION ALL SELECT 'link_down', CASE WHEN 1000000000 - last > 86400000 THEN 'info' ELSE 'critical' END, label || ' is down', rid::VARCHAR FROM l WHERE oper_status = 'down'
 UNION ALL SELECT 'link_flapping', CASE flap_state WHEN 'flapping' THEN 'critical' ELSE 'warning' END, label || ' is ' || flap_state, rid::VARCHAR FROM l WHERE flap_state <> 'stable'
 UNION ALL SELECT 'high_utilisation', CASE WHEN use >= 95 THEN 'critical' ELSE 'warning' END, label || ' is busy', rid::VARCHAR FROM l WHERE use >= 80
 UNION ALL SELECT 'high_errors', CASE WHEN errors >= 5 THEN 'critical' ELSE 'warning' END, label || ' has errors', rid::VARCHAR FROM l WHERE errors >= 1
 UNION ALL SELECT 'peer_down', 'critical', label || ' is down', id::VARCHAR FROM s WHERE state = 'down'
 UNION ALL SELECT 'peer_flapping', 'critical', label || ' is flapping', id::VARCHAR FROM s WHERE flap = 'flapping')
SELECT *, {_SEVERITY} AS rank FROM p""")  # fmt: skip
def top_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Some links have no means of the hour, some devices never reported; a
    link's age is that of its fresher end."""
    nation, r = F.col("nation"), F.col("rid")
    d = devices(spark, folder).withColumns({"snmp_health": F.when(F.col("source_adapter") == "s", "unreachable").when(nation == 5, "restricted").when(nation % 6 == 0, "unpolled"), "last_reported_at": F.when(nation % 2 == 0, 0).when(nation % 5 > 0, 1000000000)})
    k = F.col("s_suppkey")
    s = table(spark, folder, "supplier").select(k.alias("id"), F.col("s_name").alias("label"), F.when(k % 4 == 0, "down").otherwise("up").alias("state"), F.when(k % 9 == 0, "flapping").alias("flap_state"))
    ends = d.select("id", "name")
    l = link_facts(spark, folder).join(ends.toDF("src", "a_name"), "src").join(ends.toDF("dst", "b_name"), "dst")
    l = l.withColumns({"util_pct": 2 * F.col("util_avg_1h"), "error_rate_per_s": 2 * F.col("error_avg_1h")}).withColumns({"util_avg_1h": F.when(r % 3 > 0, F.col("util_avg_1h")), "error_avg_1h": F.when(r % 4 > 0, F.col("error_avg_1h"))})
    return report.problems(d, l, s, 1000000000)


@query("routing_topology", """
SELECT 'p' || l_partkey AS prefix, array_to_string(list_sort(list(DISTINCT 's' || l_suppkey)), ',') AS devices, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1""")  # fmt: skip
def routing_topology(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("prefix"), F.concat(F.lit("s"), "l_suppkey").alias("device"))
    return report.routing_topology(rows).withColumn("devices", F.array_join("devices", ","))


@query("vlan_inventory", f"""
WITH {DEVICES}, m AS (SELECT CAST(substr(id, 2) AS BIGINT) % 40 + 1 AS vid, id AS device, 'site' || nation AS site FROM devices)
SELECT vid, count(DISTINCT device) AS n_devices, array_to_string(list_sort(list(DISTINCT site)), ',') AS sites FROM m GROUP BY vid HAVING bool_or(site LIKE '%site7%')""")  # fmt: skip
def vlan_inventory(spark: SparkSession, folder: str) -> DataFrame:
    k = F.substr("id", F.lit(2)).cast("bigint")
    members = devices(spark, folder).select((k % 40 + 1).alias("vid"), F.lit("x").alias("name"), F.col("id").alias("device"), F.concat(F.lit("site"), "nation").alias("site"))
    return report.vlan_inventory(members, site="SITE7").select("vid", F.size("devices").cast("bigint").alias("n_devices"), F.array_join("sites", ",").alias("sites"))


@query("vlan_canonicalise", f"""
WITH {DEVICES}, m AS (SELECT id, CAST(substr(id, 2) AS BIGINT) % 12 + 1 AS vid, 'ps' || nation AS ps, CASE WHEN nation % 3 = 0 AND source_adapter = 's' THEN 'slug' || nation END AS slug FROM devices),
s AS (SELECT ps, mode(slug ORDER BY slug) AS s FROM m GROUP BY ps)
SELECT CASE WHEN coalesce(slug, s) IS NOT NULL THEN 'vlan:nb:' || coalesce(slug, s) || ':' || vid ELSE 'vlan:' || m.ps || ':' || vid END AS canonical, vid, count(DISTINCT id) AS n FROM m JOIN s USING (ps) GROUP BY 1, 2""")  # fmt: skip
def vlan_canonicalise(spark: SparkSession, folder: str) -> DataFrame:
    k = F.substr("id", F.lit(2)).cast("bigint")
    slug = F.when((F.col("nation") % 3 == 0) & (F.col("source_adapter") == "s"), F.concat(F.lit("slug"), "nation"))
    members = devices(spark, folder).select(F.col("id").alias("device"), (k % 12 + 1).alias("vid"), F.lit("x").alias("name"), slug.alias("site_slug"), F.concat(F.lit("ps"), "nation").alias("platform_site"))
    return decorate.canonical_vlans(members).select("canonical", "vid", F.size("devices").cast("bigint").alias("n"))


@query("stp_topology", """
WITH m AS (SELECT DISTINCT s_nationkey AS domain, s_suppkey AS device, s_suppkey % 6 = 0 AS is_root FROM supplier),
p AS (SELECT s_suppkey AS device, 'Gi0/' || (i + 1) AS interface FROM supplier, unnest(range(0, 2)) t(i) WHERE s_suppkey % 3 = 0)
SELECT domain, count(DISTINCT m.device) AS members, count(interface) AS ports, min(m.device) AS first FROM m LEFT JOIN p USING (device) GROUP BY domain""")  # fmt: skip
def stp_topology(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("domain"), F.col("s_suppkey").alias("device"), (F.col("s_suppkey") % 6 == 0).alias("is_root"))
    ports = s.where("device % 3 = 0").select("domain", "device", F.explode(F.array(F.lit("Gi0/1"), F.lit("Gi0/2"))).alias("interface"), F.lit("forwarding").alias("state"), F.lit("designated").alias("role"))
    doc = report.stp_document(s, ports)
    n_ports = F.aggregate("members", F.lit(0), lambda n, m: n + F.greatest(F.size(m["ports"]), F.lit(0)))
    return doc.select("domain", F.size("members").cast("bigint").alias("members"), n_ports.cast("bigint").alias("ports"), F.col("members")[0]["device"].alias("first"))


@query("peers_list", f"""
WITH {LINKS} SELECT src AS a, dst AS b, proto AS protocol, max(CASE WHEN rid % 2 = 0 THEN 'up' ELSE 'down' END) AS state FROM links GROUP BY ALL""")  # fmt: skip
def peers_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = links(spark, folder).withColumns({"protocol": F.col("proto"), "state": F.when(F.col("rid") % 2 == 0, "up").otherwise("down"), "flap_state": F.lit("stable")})
    both = rows.select("src", "dst", "protocol", "state", "flap_state")
    return report.peers(both.union(both.select(F.col("dst"), F.col("src"), "protocol", "state", "flap_state"))).select("a", "b", "protocol", "state")


@query("profile_match", f"""
WITH {DEVICES}, x AS (SELECT id, CASE WHEN nation = 3 THEN 1 WHEN source_adapter = 's' AND balance < 0 THEN 2 WHEN source_adapter = 'c' AND role LIKE 'AUTO%' THEN 3 WHEN name LIKE 'Supplier%1' THEN 4 END AS k, name FROM devices)
SELECT id, coalesce(['third', 'poor', 'cars', 'ones'][k], 'default') AS profile FROM (SELECT id, CASE WHEN k = 4 AND NOT regexp_matches(name, '1$') THEN NULL ELSE k END AS k FROM x)""")  # fmt: skip
def profile_match(spark: SparkSession, folder: str) -> DataFrame:
    d = devices(spark, folder).select("id", "name", "source_adapter", F.concat(F.lit("1.3."), "nation", F.lit(".")).alias("sys_object_id"), F.concat_ws("-", "role", "status").alias("model"))
    rules = spark.createDataFrame([(1, "third", "1.3.3.", None, None, None), (2, "poor", None, None, "*-down", "s"), (3, "cars", None, None, "AUTO*", "c"), (4, "ones", None, "^Supplier.*1$", None, None)], "ordinal int, profile string, oid_prefix string, name_regex string, model_glob string, adapter string")
    return report.match_profiles(d, rules).select("id", "profile")


@query("absorbed_prefixes", """
WITH p AS (SELECT p_partkey AS prefix FROM part), v AS (SELECT l_partkey AS prefix, min(l_suppkey)::VARCHAR AS v FROM lineitem WHERE l_quantity > 48 GROUP BY 1), l AS (SELECT l_partkey AS prefix, min(l_orderkey)::VARCHAR AS l FROM lineitem WHERE l_quantity < 2 GROUP BY 1)
SELECT prefix, coalesce(v, l) AS absorbed_by, CASE WHEN v IS NOT NULL THEN 'vlan' WHEN l IS NOT NULL THEN 'link' END AS absorbed_into FROM p LEFT JOIN v USING (prefix) LEFT JOIN l USING (prefix)""")  # fmt: skip
def absorbed_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    vlans = li.where("l_quantity > 48").select(F.col("l_suppkey").alias("vlan"), F.col("l_partkey").alias("prefix"))
    on = li.where("l_quantity < 2").select(F.col("l_orderkey").alias("rid"), F.array("l_partkey").alias("prefixes"))
    return decorate.absorbed_prefixes(table(spark, folder, "part").select(F.col("p_partkey").alias("prefix")), vlans, on)


@query("adjacency_collapse", f"""
WITH {LINES}, s AS (SELECT src, dst, CASE l_partkey % 6 WHEN 0 THEN 'up' WHEN 5 THEN 'unknown' ELSE 'down' END AS state FROM lines)
SELECT src, dst, CASE WHEN bool_or(state = 'up') THEN 'up' WHEN bool_or(state = 'down') THEN 'down' ELSE 'unknown' END AS state FROM s GROUP BY src, dst""")  # fmt: skip
def adjacency_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions told by either end, in states of several protocols or none."""
    rows = lines(spark, folder)
    state = F.element_at(F.array(*map(F.lit, ("Established", "2way", "idle", "twoWay", "loading", " "))), (F.col("l_partkey") % 6 + 1).cast("int"))
    turn = F.col("l_linenumber") % 2 == 0
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    none = F.lit(None).cast("bigint")
    sessions = rows.select(F.lit("bgp").alias("proto"), pick("src", "dst").alias("device"), pick("dst", "src").alias("remote_device"), pick("src", "dst").alias("local_ip"), pick("dst", "src").alias("peer_ip"), none.alias("local_as"), none.alias("remote_as"), state.alias("state"))
    return decorate.adjacencies(sessions).select("src", "dst", "state")


@query("gc_orphans", f"""
WITH {LINES}, {DEVICES} SELECT id FROM devices WHERE source_adapter = 'c' AND nation < 10 AND id NOT IN (SELECT src FROM lines WHERE l_returnflag = 'R' AND l_discount > 0.08)""")  # fmt: skip
def gc_orphans(spark: SparkSession, folder: str) -> DataFrame:
    nodes = devices(spark, folder).select("id", F.lit("Device").alias("type"), ((F.col("source_adapter") == "c") & (F.col("nation") < 10)).alias("stub"))
    return housekeeping.orphans(nodes, lines(spark, folder).where("l_returnflag = 'R' and l_discount > 0.08").select("src", "dst")).select("id")


@query("reverse_link_collapse", f"""
WITH {LINKS}, x AS (SELECT *, src AS s, dst AS d FROM links UNION ALL SELECT rid + 1, * EXCLUDE (rid), dst, src FROM links WHERE rid % 3 = 0)
SELECT rid FROM x WHERE NOT (s > d AND EXISTS (SELECT 1 FROM x y WHERE y.s = x.d AND y.d = x.s AND ((y.interface_a = x.interface_a AND y.interface_b = x.interface_b) OR (y.interface_a = x.interface_b AND y.interface_b = x.interface_a))))""")  # fmt: skip
def reverse_link_collapse(spark: SparkSession, folder: str) -> DataFrame:
    rows = links(spark, folder).select("rid", "src", "dst", "interface_a", "interface_b")
    back = rows.where("rid % 3 = 0").select(F.col("rid") + 1, "dst", "src", "interface_a", "interface_b")
    return housekeeping.without_reversed(rows.union(back)).select("rid")
