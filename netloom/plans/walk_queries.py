"""Queries over walks in their text form, made of the tables' rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import snmp, walk_tables
from netloom.operators.paths import _cut
from netloom.plans.catalog import query
from netloom.plans.graph import table


def _walk(rows: DataFrame, lines: list[tuple[str, Column, str, Column]]) -> DataFrame:
    """The walk of ``rows(device)`` with a line for each (oid, index, kind, value),
    written once: tables of it are read several times."""
    text = [rows.select("device", F.concat(F.lit(f".{oid}."), index, F.lit(f" = {kind}: "), value).alias("line")) for oid, index, kind, value in lines]
    return _cut(snmp.parse_lines(reduce(DataFrame.union, text).where("line is not null")))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _found(rows: DataFrame) -> DataFrame:
    p = lambda c: F.col("props")[c].alias(c)
    return rows.select("kind", F.coalesce("id", F.concat_ws(" ", "src", "dst")).alias("item"), "interface_a", "interface_b", p("name"), p("chassis_mac"), p("mgmt_ip"), p("platform"))


@query("lldp_walk", """
WITH c AS (SELECT c_custkey AS k, 's' || (c_custkey % (SELECT count(*) FROM supplier) + 1) AS device, c_custkey % 40 AS port,
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'host' || (c_custkey % 700) END AS name,
    CASE WHEN c_custkey % 5 > 0 THEN '00:00:00:00:' || lpad(lower(to_hex(c_custkey % 700 // 256)), 2, '0') || ':' || lpad(lower(to_hex(c_custkey % 700 % 256)), 2, '0') END AS mac,
    CASE WHEN c_custkey % 3 > 0 THEN '10.' || c_custkey % 7 || '.' || c_custkey % 700 // 256 || '.' || c_custkey % 700 % 256 END AS ip FROM customer),
n AS (SELECT *, CASE WHEN name <> '' THEN 'lldp-neighbor:' || name WHEN mac IS NOT NULL THEN 'lldp-neighbor:by-id:' || mac WHEN ip IS NOT NULL THEN 'lldp-neighbor:by-id:' || ip END AS neighbor FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY neighbor ORDER BY device, k, port) AS r FROM n WHERE neighbor IS NOT NULL)
SELECT 'node' AS kind, neighbor AS item, NULL AS interface_a, NULL AS interface_b, CASE WHEN name <> '' THEN name ELSE coalesce(mac, ip) END AS name, mac AS chassis_mac, ip AS mgmt_ip, 'unknown' AS platform FROM s WHERE r = 1
UNION ALL SELECT 'edge', device || ' ' || neighbor, CASE WHEN port % 2 = 0 THEN 'GigabitEthernet1/' || port ELSE 'if-' || port END, CASE WHEN k % 4 = 0 THEN 'uplink ' || k ELSE 'Ethernet1/' || (k % 9) END, NULL, NULL, NULL, NULL FROM s""")  # fmt: skip
def lldp_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as neighbours of suppliers: some without a usable name, hardware
    address or address; interfaces by number where the walk names them."""
    n = table(spark, folder, "supplier").count()
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(F.concat(F.lit("s"), k % n + 1).alias("device"), k, (k % 40).alias("port"))
    index = F.concat_ws(".", k, "port", F.lit(1))
    low, text = k % 700, lambda c: c.cast("string")
    ip = F.concat_ws(".", F.lit(10), k % 7, F.floor(low / 256), low % 256)
    lines = [
        ("1.0.8802.1.1.2.1.4.1.1.9", index, "STRING", _quoted(F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("host"), low, F.lit(".example.net"))))),
        ("1.0.8802.1.1.2.1.4.1.1.4", index, "INTEGER", F.lit("4")),
        ("1.0.8802.1.1.2.1.4.1.1.5", index, "Hex-STRING", F.when(k % 5 > 0, F.concat(F.lit("00 00 00 00 "), F.lpad(F.hex(F.floor(low / 256)), 2, "0"), F.lit(" "), F.lpad(F.hex(low % 256), 2, "0")))),
        ("1.0.8802.1.1.2.1.4.1.1.7", index, "STRING", F.when(k % 4 > 0, _quoted(F.concat(F.lit("Eth1/"), k % 9)))),
        ("1.0.8802.1.1.2.1.4.1.1.8", index, "STRING", _quoted(F.concat(F.lit("uplink "), k))),
        ("1.0.8802.1.1.2.1.4.2.1.4", F.when(k % 3 > 0, F.concat_ws(".", index, F.lit(1), F.lit(4), ip)), "INTEGER", F.lit("2")),
        ("1.0.8802.1.1.2.1.4.2.1.4", F.concat_ws(".", index, F.lit(1), F.lit(9), F.lit(1)), "INTEGER", F.lit("2")),
        ("1.3.6.1.2.1.31.1.1.1.1", F.when(F.col("port") % 2 == 0, text(F.col("port"))), "STRING", _quoted(F.concat(F.lit("Gi1/"), "port"))),
    ]
    walk = _walk(rows, lines)
    return _found(walk_tables.graph_rows(walk_tables.lldp(walk), snmp.interfaces(walk), "lldp", 500))


@query("cdp_walk", """
WITH c AS (SELECT s_suppkey AS k, 'n' || s_nationkey AS device, CASE WHEN s_suppkey % 6 = 0 THEN '12' ELSE 'router' || s_suppkey END AS name,
    CASE WHEN s_suppkey % 4 > 0 THEN '10.0.' || s_suppkey // 256 || '.' || s_suppkey % 256 END AS ip FROM supplier),
n AS (SELECT *, CASE WHEN name <> '12' THEN 'cdp-neighbor:' || name WHEN ip IS NOT NULL THEN 'cdp-neighbor:by-id:' || ip END AS neighbor FROM c)
SELECT 'node' AS kind, neighbor AS item, NULL AS interface_a, NULL AS interface_b, name, NULL AS chassis_mac, ip AS mgmt_ip, CASE WHEN k % 2 = 0 THEN 'C9300' ELSE 'cisco' END AS platform FROM n WHERE neighbor IS NOT NULL
UNION ALL SELECT 'edge', device || ' ' || neighbor, 'if-' || k % 30, 'TenGigabitEthernet1/1/' || k % 4, NULL, NULL, NULL, NULL FROM n WHERE neighbor IS NOT NULL""")  # fmt: skip
def cdp_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as neighbours of nations, addresses as four bytes."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("device"), k)
    index = F.concat_ws(".", k % 30, k)
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    lines = [
        ("1.3.6.1.4.1.9.9.23.1.2.1.1.6", index, "STRING", _quoted(F.when(k % 6 == 0, "12").otherwise(F.concat(F.lit("router"), k, F.lit(".net"))))),
        ("1.3.6.1.4.1.9.9.23.1.2.1.1.4", index, "Hex-STRING", F.when(k % 4 > 0, F.concat_ws(" ", F.lit("0A 00"), byte(F.floor(k / 256)), byte(k % 256)))),
        ("1.3.6.1.4.1.9.9.23.1.2.1.1.7", index, "STRING", _quoted(F.concat(F.lit("Te1/1/"), k % 4))),
        ("1.3.6.1.4.1.9.9.23.1.2.1.1.8", index, "STRING", F.when(k % 2 == 0, _quoted(F.lit("C9300")))),
    ]
    walk = _walk(rows, lines)
    return _found(walk_tables.graph_rows(walk_tables.cdp(walk), snmp.interfaces(walk), "cdp"))


@query("stp_walk", """
WITH b AS (SELECT s_suppkey AS k, 's' || s_suppkey AS device, CASE WHEN s_nationkey % 5 = 0 THEN 'stp:s' || s_suppkey || ':default' ELSE 'stp-domain:00:00:00:00:00:' || lpad(lower(to_hex(s_nationkey)), 2, '0') END AS d FROM supplier WHERE s_suppkey % 7 > 0),
p AS (SELECT b.*, unnest(range(1, 5)) AS port FROM b)
SELECT 'STP_MEMBER' AS type, device AS src, d AS dst, CAST(k % 8 * 4096 AS INTEGER) AS priority, NULL AS state, CAST(k % 9 AS INTEGER) AS root_path_cost FROM b
UNION ALL SELECT 'STP_ROOT', device, d, CAST(k % 8 * 4096 AS INTEGER), NULL, NULL FROM b WHERE k % 3 = 0
UNION ALL SELECT 'STP_LINK', 'snmp-if:' || device || CASE WHEN port < 4 THEN ':Gi1/' || port + 100 ELSE ':port-4' END, d, NULL, CASE (k + port) % 6 + 1 WHEN 2 THEN 'blocking' WHEN 3 THEN 'listening' WHEN 4 THEN 'learning' WHEN 5 THEN 'forwarding' WHEN 6 THEN 'broken' END, NULL FROM p WHERE (k + port) % 6 > 0""")  # fmt: skip
def stp_walk(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as bridges of four ports each, the last without an interface."""
    k = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(F.concat(F.lit("s"), k).alias("device"), k, "s_nationkey")
    zero, text = F.lit("0"), lambda c: c.cast("string")
    lines = [
        ("1.3.6.1.2.1.17.2.2", F.when(k % 7 > 0, zero), "INTEGER", text(k % 8 * 4096)), ("1.3.6.1.2.1.17.2.7", zero, "INTEGER", text(k % 3)), ("1.3.6.1.2.1.17.2.6", zero, "INTEGER", text(k % 9)),
        ("1.3.6.1.2.1.17.2.5", zero, "Hex-STRING", F.when(F.col("s_nationkey") % 5 > 0, F.concat(F.lit("80 00 00 00 00 00 00 "), F.lpad(F.hex("s_nationkey"), 2, "0")))),
    ]
    for port in range(1, 5):
        at = F.lit(str(port))
        lines.append(("1.3.6.1.2.1.17.2.15.1.3", at, "INTEGER", text((k + port) % 6 + 1)))
        if port < 4:
            lines += [("1.3.6.1.2.1.17.1.4.1.2", at, "INTEGER", F.lit(str(port + 100))), ("1.3.6.1.2.1.31.1.1.1.1", F.lit(str(port + 100)), "STRING", F.lit(f'"Gi1/{port + 100}"'))]
    return walk_tables.spanning_tree(_walk(rows, lines)).select("type", "src", "dst", "priority", "state", "root_path_cost")
