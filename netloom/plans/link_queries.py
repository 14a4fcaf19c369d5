"""Queries over links and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.network import ipv4_text, ipv6_text, network4
from netloom.operators import decorate, links as L, paths, resolve
from netloom.plans.catalog import query
from netloom.plans.graph import DEVICES, LINES, LINKS, STEPS, devices, lines, links, table, topology

_PRIO = "CASE proto WHEN 'lldp' THEN 100 WHEN 'cdp' THEN 95 WHEN 'catc_topology' THEN 85 WHEN 'mac_correlation' THEN 50 WHEN 'arp_correlation' THEN 30 ELSE 0 END"
_LONG = "CASE WHEN {0} LIKE 'Gi%' THEN 'GigabitEthernet' || substr({0}, 3) WHEN {0} LIKE 'Eth%' THEN 'Ethernet' || substr({0}, 4) ELSE {0} END"


@query("mac_correlation", f"""
WITH {LINES}, learned AS (SELECT DISTINCT src AS device, 'Gi' || l_linenumber AS interface, l_partkey AS mac FROM lines WHERE l_linenumber % 2 = 1),
owned AS (SELECT DISTINCT dst AS device, l_partkey AS mac FROM lines WHERE l_linenumber % 2 = 0),
trusted AS (SELECT DISTINCT src, dst FROM lines WHERE l_discount > 0.08),
met AS (SELECT l.device, l.interface, l.mac, o.device AS owner FROM learned l JOIN owned o USING (mac) WHERE NOT EXISTS (SELECT 1 FROM trusted t WHERE t.src = l.device AND t.dst = o.device)),
best AS (SELECT *, row_number() OVER (PARTITION BY device, owner ORDER BY interface, mac) AS k FROM met)
SELECT device AS src, owner AS dst, interface AS interface_a, 'mac_correlation' AS proto, 0.85::DOUBLE AS confidence, mac FROM best WHERE k = 1""")  # fmt: skip
def mac_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    learned = rows.where("l_linenumber % 2 = 1").select(F.col("src").alias("device"), F.concat(F.lit("Gi"), "l_linenumber").alias("interface"), F.col("l_partkey").alias("mac")).distinct()
    owned = rows.where("l_linenumber % 2 = 0").select(F.col("dst").alias("device"), F.col("l_partkey").alias("mac")).distinct()
    trusted = rows.where("l_discount > 0.08").select("src", "dst", F.lit("lldp").alias("proto"))
    return L.from_macs(learned, owned, trusted).select("src", "dst", "interface_a", "proto", "confidence", "mac")


@query("arp_correlation", f"""
WITH {LINES}, bound AS (SELECT DISTINCT src AS device, 'Gi' || l_linenumber AS interface, o_orderkey % 5000 AS ip, l_partkey AS mac FROM lines WHERE l_linenumber % 2 = 1),
owned AS (SELECT DISTINCT dst AS device, l_orderkey % 5000 AS ip FROM lines WHERE l_linenumber % 2 = 0),
known AS (SELECT DISTINCT src, dst FROM lines WHERE l_discount > 0.07),
best AS (SELECT b.*, o.device AS owner, row_number() OVER (PARTITION BY b.device, o.device ORDER BY interface, mac) AS k FROM bound b JOIN owned o USING (ip)
  WHERE NOT EXISTS (SELECT 1 FROM known t WHERE t.src = b.device AND t.dst = o.device))
SELECT device AS src, owner AS dst, interface AS interface_a, 0.65::DOUBLE AS confidence, mac FROM best WHERE k = 1""")  # fmt: skip
def arp_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder)
    bound = rows.where("l_linenumber % 2 = 1").select(F.col("src").alias("device"), F.concat(F.lit("Gi"), "l_linenumber").alias("interface"), (F.col("o_orderkey") % 5000).alias("ip"), F.col("l_partkey").alias("mac")).distinct()
    owned = rows.where("l_linenumber % 2 = 0").select(F.col("dst").alias("device"), (F.col("l_orderkey") % 5000).alias("ip")).distinct()
    known = rows.where("l_discount > 0.07").select("src", "dst", F.lit("mac_correlation").alias("proto"))
    return L.from_arp(bound, owned, known).select("src", "dst", "interface_a", "confidence", "mac")


_DEDUPED = f"""kept AS (SELECT * FROM links l WHERE NOT (proto IN ('mac_correlation', 'arp_correlation') AND EXISTS (SELECT 1 FROM links h WHERE h.src = l.src AND h.dst = l.dst AND h.proto IN ('lldp', 'cdp', 'catc_topology')))),
best AS (SELECT *, row_number() OVER (PARTITION BY src, dst, least(interface_a, interface_b), greatest(interface_a, interface_b) ORDER BY {_PRIO} DESC, confidence DESC, rid) AS k FROM kept),
one AS (SELECT * EXCLUDE (k) FROM best WHERE k = 1)"""


@query("link_dedupe", f"""
WITH RECURSIVE {LINKS}, {_DEDUPED}, ports AS (SELECT rid, src, dst, unnest([{_LONG.format("interface_a")}, {_LONG.format("interface_b")}]) AS port FROM one),
near AS (SELECT DISTINCT a.rid AS x, b.rid AS y FROM ports a JOIN ports b USING (src, dst, port)),
reach AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
cable AS (SELECT x AS rid, min(y) AS cable FROM reach GROUP BY x),
ranked AS (SELECT one.*, row_number() OVER (PARTITION BY cable ORDER BY {_PRIO} DESC, confidence DESC, rid) AS k FROM one JOIN cable USING (rid))
SELECT rid, src, dst, interface_a, interface_b, proto, confidence FROM ranked WHERE k = 1""")  # fmt: skip
def link_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return L.deduplicated(links(spark, folder))


_HEALTH = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'down' WHEN s_suppkey % 3 = 1 THEN 'up' END AS oper, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 100 END AS hs FROM supplier"""


@query("link_health_rollup", f"""
WITH {LINKS}, named AS (SELECT *, CASE WHEN rid % 10 = 3 THEN 'Gi0/9' ELSE interface_a END AS near, CASE WHEN rid % 4 > 0 THEN 'up' END AS was, rid % 77 AS score FROM links),
ports AS (
  SELECT DISTINCT src AS device, near AS name, CAST(substr(src, 2) AS BIGINT) AS k FROM named WHERE CAST(substr(src, 2) AS BIGINT) % 5 <> 0
  UNION SELECT DISTINCT dst, interface_b, CAST(substr(dst, 2) AS BIGINT) FROM links WHERE CAST(substr(dst, 2) AS BIGINT) % 7 <> 0),
facts AS (SELECT device, name, CASE k % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'UP' END AS oper, CASE WHEN k % 4 > 0 THEN k % 100 END AS hs, k % 90 AS util, (k % 8) / 4 AS errors FROM ports),
sides AS (SELECT l.*, a.oper AS ao, a.hs AS ah, a.util AS au, a.errors AS ae, b.oper AS bo, b.hs AS bh, b.util AS bu, b.errors AS be, (a.hs IS NOT NULL OR a.oper IS NOT NULL) AS ta, (b.hs IS NOT NULL OR b.oper IS NOT NULL) AS tb
  FROM named l LEFT JOIN facts a ON a.device = l.src AND a.name = l.near LEFT JOIN facts b ON b.device = l.dst AND b.name = l.interface_b),
told AS (SELECT *, ta OR tb AS t, CASE WHEN lower(coalesce(ao, '')) = 'down' OR lower(coalesce(bo, '')) = 'down' THEN 'down' WHEN lower(coalesce(ao, '')) = 'up' OR lower(coalesce(bo, '')) = 'up' THEN 'up' END AS oper FROM sides)
SELECT rid, CASE WHEN t THEN oper ELSE was END AS oper_status, CASE WHEN t THEN greatest(coalesce(ah, 0), coalesce(bh, 0)) ELSE score END AS health_score, CASE WHEN t THEN greatest(coalesce(au, 0), coalesce(bu, 0)) END AS util_pct,
  CASE WHEN t THEN coalesce(ae, 0) + coalesce(be, 0) END AS error_rate_per_s, CASE WHEN t THEN NOT (ta AND tb) END AS single_sided, CASE WHEN t AND oper IS NOT NULL AND oper IS DISTINCT FROM was THEN 5000 ELSE 7 END AS changed_at FROM told""")  # fmt: skip
def link_health_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Links with a stored state and score, some with an active interface other
    than the one they are named by; suppliers by sevens tell nothing."""
    r = F.col("rid")
    rows = paths._stored(links(spark, folder)).withColumns({"interface_a_active": F.when(r % 10 == 3, "Gi0/9"), "oper_status": F.when(r % 4 > 0, "up"), "health_score": r % 77, "changed_at": F.lit(7).cast("bigint")})
    k = F.substr("device", F.lit(2)).cast("bigint")
    near = F.coalesce("interface_a_active", "interface_a")
    ports = rows.select(F.col("src").alias("device"), near.alias("name")).where(k % 5 != 0).union(rows.select(F.col("dst").alias("device"), "interface_b").where(k % 7 != 0)).distinct()
    facts = ports.withColumns({"oper_status": F.when(k % 3 == 0, "down").when(k % 3 == 1, "UP"), "health_score": F.when(k % 4 > 0, k % 100), "util_in_pct": k % 90, "util_out_pct": F.lit(0).cast("bigint"), "error_rate": (k % 8) / 4})
    return L.with_health(rows, facts, 5000).select("rid", "oper_status", "health_score", "util_pct", "error_rate_per_s", "single_sided", "changed_at")


@query("l2_carried_vlans", """
WITH o AS (SELECT o_orderkey AS rid, o_custkey AS c, o_orderkey % 50 AS d FROM orders), s AS (SELECT *, list_transform(range(1, c % 7 + 2), lambda x: (x * 3 + c) % 20 + 1) AS va, list_transform(range(1, d % 9 + 2), lambda x: (x * 2 + d) % 20 + 1) AS vb FROM o),
f AS (SELECT rid, CASE WHEN c % 4 = 0 THEN [c % 20 + 1] WHEN c % 4 = 1 THEN NULL ELSE va END AS a, CASE WHEN d % 5 = 0 THEN NULL ELSE vb END AS b FROM s)
SELECT rid, array_to_string(list_sort(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN list_intersect(a, b) ELSE coalesce(a, b) END), ',') AS carried FROM f""")  # fmt: skip
def l2_carried_vlans(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("rid"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("d"), F.col("o_orderkey") % 50).alias("dst"), F.lit("Te1/0/1").alias("interface_a"), F.lit("Eth1/1").alias("interface_b"))
    k = F.substr("device", F.lit(2)).cast("bigint")
    vlans = lambda n, step: F.transform(F.sequence(F.lit(1), (k % n + 1).cast("int")), lambda x: (x * step + k) % 20 + 1)
    none = F.lit(None).cast("array<bigint>")
    a = o.select(F.col("src").alias("device")).distinct().select("device", F.lit("TenGigabitEthernet1/0/1").alias("name"), F.when(k % 4 == 0, "access").when(k % 4 > 1, "trunk").alias("trunk_mode"), F.when(k % 4 > 1, vlans(7, 3)).otherwise(none).alias("vlans_allowed"), F.when(k % 4 == 0, k % 20 + 1).alias("vlans_access"))
    b = o.select(F.col("dst").alias("device")).distinct().select("device", F.lit("Ethernet1/1").alias("name"), F.when(k % 5 != 0, "trunk").alias("trunk_mode"), F.when(k % 5 != 0, vlans(9, 2)).otherwise(none).alias("vlans_allowed"), F.lit(None).cast("bigint").alias("vlans_access"))
    return L.with_vlans(o, a.union(b)).select("rid", F.array_join(F.array_sort("vlans_carried").cast("array<string>"), ",").alias("carried"))


@query("prefix_containment", """
WITH ip AS (SELECT s_suppkey AS device, 167772160 + s_suppkey * 37 AS a FROM supplier), nets AS (SELECT DISTINCT (a // 256) * 256 AS network, 24 AS len FROM ip WHERE device % 2 = 0 UNION SELECT DISTINCT (a // 4096) * 4096, 20 FROM ip)
SELECT x.device AS src, y.device AS dst, n.len AS prefix_len, n.network FROM ip x JOIN nets n ON x.a >= n.network AND x.a < n.network + (1::BIGINT << (32 - n.len)) JOIN ip y ON y.a >= n.network AND y.a < n.network + (1::BIGINT << (32 - n.len)) AND x.device + 1 = y.device""")  # fmt: skip
def prefix_containment(spark: SparkSession, folder: str) -> DataFrame:
    ip = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("device"), (F.lit(167772160) + F.col("s_suppkey") * 37).alias("address"))
    nets = ip.where("device % 2 = 0").select(network4(F.col("address"), 24).alias("network"), F.lit(24).alias("prefix_len")).union(ip.select(network4(F.col("address"), 20), F.lit(20))).distinct()
    pairs = ip.select(F.col("device").alias("src"), (F.col("device") + 1).alias("dst"))
    return decorate.containing(pairs, ip, nets, lengths=(20, 24)).select("src", "dst", "prefix_len", "network")


@query("longest_prefix", """
WITH peer AS (SELECT c_custkey AS peer, CASE WHEN c_custkey % 3 = 0 THEN 6 ELSE 4 END AS v, 167772160 + c_custkey * 13 AS a FROM customer),
ifs AS (SELECT s_suppkey AS iface, v, 167772160 + s_suppkey * 101 AS a, s_acctbal AS health FROM supplier, unnest([4, 6]) t(v)),
m AS (SELECT peer, iface, health, least(CASE p.v WHEN 4 THEN 31 ELSE 127 END, CASE p.v WHEN 4 THEN 32 ELSE 128 END - length(bin(xor(p.a, i.a)))) AS len FROM peer p JOIN ifs i ON p.v = i.v AND (p.v = 6 OR (p.a >> 8) = (i.a >> 8))),
r AS (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY len DESC, health DESC, iface) AS k FROM m)
SELECT peer, iface, len::BIGINT AS prefix_len FROM r WHERE k = 1""")  # fmt: skip
def longest_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """Every third peer by IPv6; interfaces have an address of each version."""
    number = lambda c, by: F.lit(167772160) + F.col(c) * by
    six = lambda n: ipv6_text(F.concat(F.lit("20010db800000000"), F.lpad(F.lower(F.hex(n)), 16, "0")))
    of = number("c_custkey", 13)
    peers = table(spark, folder, "customer").select(F.col("c_custkey").alias("peer"), F.when(F.col("c_custkey") % 3 == 0, six(of)).otherwise(ipv4_text(of)).alias("peer_ip"))
    n = number("s_suppkey", 101)
    ifs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("iface"), F.explode(F.array(ipv4_text(n), six(n))).alias("ip"), F.col("s_acctbal").alias("health"))
    return decorate.egress(peers, ifs, [F.col("health"), -F.col("iface")]).select("peer", "iface", F.col("prefix_len").cast("bigint").alias("prefix_len"))


_NETS = """ip AS (SELECT s_suppkey AS device, 167772160 + s_suppkey * 37 AS a FROM supplier),
nets AS (
  SELECT DISTINCT 4 AS v, len, (a >> (32 - len)) << (32 - len) AS lo FROM ip, unnest([16, 20, 24, 28]) t(len) WHERE device % 2 = 0 OR len > 20
  UNION SELECT DISTINCT 6, 96 + len, (a >> (32 - len)) << (32 - len) FROM ip, unnest([12, 22, 26, 32]) t(len) WHERE device % 3 > 0 OR len < 26),
named AS (SELECT *, lo + (1::BIGINT << (CASE v WHEN 4 THEN 32 ELSE 128 END - len)) AS hi, v || '/' || lo || '/' || len AS name FROM nets)"""


def _nets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(device, ip) of both versions, and (cidr, name) of the networks around them."""
    six = lambda n: ipv6_text(F.concat(F.lit("20010db80000000000000000"), F.lpad(F.lower(F.hex(n)), 8, "0")))
    ip = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("device"), (F.lit(167772160) + F.col("s_suppkey") * 37).alias("a"))
    lengths = lambda *n: F.explode(F.array(*map(F.lit, n))).alias("len")
    low = network4(F.col("a"), F.col("len"))
    four = ip.select("device", "a", lengths(16, 20, 24, 28)).where("device % 2 = 0 or len > 20").select(F.concat_ws("/", ipv4_text(low), "len").alias("cidr"), F.concat_ws("/", F.lit("4"), low, "len").alias("name"))
    sixes = ip.select("device", "a", lengths(12, 22, 26, 32)).where("device % 3 > 0 or len < 26").select(F.concat_ws("/", six(low), F.col("len") + 96).alias("cidr"), F.concat_ws("/", F.lit("6"), low, F.col("len") + 96).alias("name"))
    return ip.select("device", F.explode(F.array(ipv4_text(F.col("a")), six(F.col("a")))).alias("ip")), four.union(sixes).distinct()


@query("prefix_parents", f"""
WITH {_NETS} SELECT x.name, arg_max(y.name, y.len) AS parent FROM named x LEFT JOIN named y ON x.v = y.v AND y.len < x.len AND y.lo <= x.lo AND x.hi <= y.hi GROUP BY x.name""")  # fmt: skip
def prefix_parents(spark: SparkSession, folder: str) -> DataFrame:
    _, nets = _nets(spark, folder)
    found = decorate.prefix_parents(nets.select("cidr"))
    return found.join(nets, "cidr").select("name", F.col("parent").alias("_p")).join(nets.select(F.col("cidr").alias("_p"), F.col("name").alias("parent")), "_p", "left").select("name", "parent")


@query("prefix_holding", f"""
WITH {_NETS} SELECT x.device AS src, y.device AS dst, n.name FROM ip x JOIN named n ON x.a >= n.lo AND x.a < n.hi JOIN ip y ON y.a >= n.lo AND y.a < n.hi AND x.device + 1 = y.device""")  # fmt: skip
def prefix_holding(spark: SparkSession, folder: str) -> DataFrame:
    """Networks of both versions that hold both of two suppliers."""
    ips, nets = _nets(spark, folder)
    pairs = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    return decorate.holding(pairs, ips, nets.select("cidr")).join(nets, "cidr").select("src", "dst", "name")


@query("k_hop", f"""
WITH RECURSIVE {STEPS}, walk AS (SELECT 's1' AS node, 0 AS d UNION SELECT t.dst, d + 1 FROM walk w JOIN steps t ON t.src = w.node WHERE d < 4)
SELECT node, min(d) AS distance FROM walk GROUP BY node""")  # fmt: skip
def k_hop(spark: SparkSession, folder: str) -> DataFrame:
    start = spark.createDataFrame([("s1",)], "node string")
    return paths.distances(topology(spark, folder), start, 4).select("node", "distance")


_PAIRS = [("s1", "s2"), ("s1", "s5"), ("s3", "s8"), ("s2", "nowhere")]


@query("shortest_path", f"""
WITH RECURSIVE {STEPS}, starts AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)}) v(source, target)),
walk AS (SELECT DISTINCT source, source AS node, 0 AS d FROM starts UNION SELECT w.source, t.dst, d + 1 FROM walk w JOIN steps t ON t.src = w.node WHERE d < 15)
SELECT source, target, min(d) AS distance, min(d) + 1 AS nodes FROM walk JOIN starts USING (source) WHERE node = target GROUP BY source, target""")  # fmt: skip
def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spark.createDataFrame(_PAIRS, "source string, target string")
    return paths.shortest_paths(topology(spark, folder), pairs).select("source", "target", "distance", F.size("path").alias("nodes"))


@query("link_components")
def link_components(spark: SparkSession, folder: str) -> DataFrame:
    return paths.components(topology(spark, folder))


@query("wan_upstream_bfs", f"""
WITH RECURSIVE {STEPS}, {DEVICES}, gates AS (SELECT id, nation FROM devices WHERE source_adapter = 's' AND nation < 8),
edge AS (SELECT id, nation FROM devices WHERE source_adapter = 'c' AND nation % 4 = 0 AND id IN (SELECT src FROM steps)),
walk AS (SELECT id AS gate, id AS node, 0 AS d FROM gates UNION SELECT w.gate, t.dst, d + 1 FROM walk w JOIN steps t ON t.src = w.node WHERE d < 6),
hops AS (SELECT gate, node, min(d) AS d FROM walk GROUP BY ALL),
best AS (SELECT e.id, g.id AS upstream, h.d, row_number() OVER (PARTITION BY e.id ORDER BY (e.nation = g.nation) DESC, h.d, g.id) AS k FROM edge e JOIN hops h ON h.node = e.id JOIN gates g ON g.id = h.gate)
SELECT e.id AS device, coalesce(upstream, 'internet:0') AS upstream, d AS hops FROM edge e LEFT JOIN best b ON b.id = e.id AND k = 1""")  # fmt: skip
def wan_upstream_bfs(spark: SparkSession, folder: str) -> DataFrame:
    known = devices(spark, folder)
    steps = paths._stored(topology(spark, folder))
    edge = known.where("source_adapter = 'c' and nation % 4 = 0").join(steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct(), "id", "left_semi").select("id", F.col("nation").alias("site"))
    gates = known.where("source_adapter = 's' and nation < 8").select("id", F.col("nation").alias("site"))
    return decorate.upstream(edge, gates, steps).select("device", "upstream", "hops")


@query("stub_merge_by_name", f"""
WITH {DEVICES}, stubs AS (SELECT 'lldp:' || n AS id, CASE WHEN n % 3 = 0 THEN upper(s_name) || '.corp' WHEN n % 3 = 1 THEN 'unknown' || (n % 5) ELSE s_name END AS name FROM (SELECT s_suppkey AS n, s_name FROM supplier)),
real_ AS (SELECT lower(split_part(name, '.', 1)) AS label, min(id) AS real_id FROM devices GROUP BY 1),
m AS (SELECT s.id, label, real_id FROM (SELECT *, lower(split_part(name, '.', 1)) AS label FROM stubs) s LEFT JOIN real_ USING (label)),
g AS (SELECT *, min(id) OVER (PARTITION BY label) AS first FROM m WHERE real_id IS NULL)
SELECT id AS stub, real_id AS canonical FROM m WHERE real_id IS NOT NULL UNION ALL SELECT id, first FROM g WHERE id <> first""")  # fmt: skip
def stub_merge_by_name(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("s_suppkey")
    name = F.when(n % 3 == 0, F.concat(F.upper("s_name"), F.lit(".corp"))).when(n % 3 == 1, F.concat(F.lit("unknown"), n % 5)).otherwise(F.col("s_name"))
    stubs = table(spark, folder, "supplier").select(F.concat(F.lit("lldp:"), n).alias("id"), name.alias("name"), F.lit(None).cast("string").alias("discovered_via"))
    return resolve.by_name(stubs, devices(spark, folder).select("id", "name")).select("stub", "canonical")


@query("stub_absorb", f"""
WITH {LINES}, e AS (SELECT DISTINCT src, dst, 'Gi' || l_linenumber AS ia, 'Te' || (l_partkey % 3) AS ib FROM lines),
m AS (SELECT 's' || s_suppkey AS stub, 's' || (s_suppkey + 1) AS real_id FROM supplier WHERE s_suppkey % 4 = 0),
t AS (SELECT src AS s, coalesce(real_id, dst) AS d, ia, ib FROM e LEFT JOIN m ON m.stub = e.dst)
SELECT DISTINCT s AS src, d AS dst, ia AS interface_a, ib AS interface_b FROM t WHERE s <> d""")  # fmt: skip
def stub_absorb(spark: SparkSession, folder: str) -> DataFrame:
    e = lines(spark, folder).select("src", "dst", F.concat(F.lit("Gi"), "l_linenumber").alias("interface_a"), F.concat(F.lit("Te"), F.col("l_partkey") % 3).alias("interface_b"), F.lit("PHYSICAL_LINK").alias("type"), F.lit("snmp").alias("source_adapter"))
    m = table(spark, folder, "supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("stub"), F.concat(F.lit("s"), F.col("s_suppkey") + 1).alias("canonical"))
    return resolve.absorb(e, m).select("src", "dst", "interface_a", "interface_b")


@query("stp_root_election", """
WITH m AS (SELECT DISTINCT s_nationkey AS domain, s_suppkey AS device, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 8) * 4096 END AS prio, s_suppkey % 6 = 0 AS is_root FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY is_root DESC, coalesce(prio, 32768), device) AS k, count(*) OVER (PARTITION BY domain) AS size FROM m)
SELECT domain, device AS root, size FROM r WHERE k = 1""")  # fmt: skip
def stp_root_election(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    members = s.select(F.col("s_nationkey").alias("domain"), k.alias("device"), F.when(k % 5 != 0, k % 8 * 4096).alias("bridge_priority"), F.lit(None).cast("bigint").alias("stp_priority"), (k % 6 == 0).alias("is_root"))
    return decorate.domain_roots(members)


@query("home_asn_vote", """
WITH p AS (SELECT c_custkey AS peer, 's' || (c_custkey % 100 + 1) AS device, c_nationkey AS site, CASE WHEN c_custkey % 3 = 0 THEN 64512 + c_custkey % 9 ELSE 3000 + c_custkey % 17 END AS asn FROM customer)
SELECT asn, count(DISTINCT site) AS sites, count(DISTINCT device) AS devices, count(DISTINCT peer) AS peers FROM p
WHERE NOT (asn BETWEEN 64496 AND 65551) GROUP BY asn HAVING count(DISTINCT site) >= 2 OR count(DISTINCT device) >= 3
ORDER BY sites DESC, devices DESC, peers DESC, asn LIMIT 1""")  # fmt: skip
def home_asn_vote(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    peers = table(spark, folder, "customer").select(k.alias("peer"), F.concat(F.lit("s"), k % 100 + 1).alias("device"), F.col("c_nationkey").alias("site"), F.lit(None).cast("bigint").alias("local_as"), F.when(k % 3 == 0, 64512 + k % 9).otherwise(3000 + k % 17).alias("remote_as"))
    return decorate.home_asn(peers).select("asn", "sites", "devices", "peers")
