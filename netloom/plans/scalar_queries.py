"""Queries over the column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import health, names, network
from netloom.plans.catalog import query
from netloom.plans.graph import table


@query("ifname_normalise", """
WITH x AS (SELECT p_partkey AS k, ['Gi', 'te', 'Twe', 'Eth', 'PO', 'Vlan', 'xyz', 'HundredGigE'][p_partkey % 8 + 1] || (p_partkey % 4) || '/' || (p_size) AS raw FROM part)
SELECT k, CASE lower(regexp_extract(raw, '^[A-Za-z]+')) WHEN 'gi' THEN 'GigabitEthernet' WHEN 'te' THEN 'TenGigabitEthernet' WHEN 'twe' THEN 'TwentyFiveGigE' WHEN 'eth' THEN 'Ethernet' WHEN 'po' THEN 'Port-channel' WHEN 'vlan' THEN 'Vlan' WHEN 'hundredgige' THEN 'HundredGigE' ELSE 'xyz' END || substr(raw, length(regexp_extract(raw, '^[A-Za-z]+')) + 1) AS name,
  regexp_extract(raw, '[0-9].*$') AS tail FROM x""")  # fmt: skip
def ifname_normalise(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Gi", "te", "Twe", "Eth", "PO", "Vlan", "xyz", "HundredGigE"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.concat(kind, F.col("p_partkey") % 4, F.lit("/"), "p_size").alias("raw"))
    return rows.select("k", names.normalize_ifname(F.col("raw")).alias("name"), names.port_tail(F.col("raw")).alias("tail"))


@query("mac_normalise", """
WITH x AS (SELECT c_custkey AS k, md5(c_name) AS h FROM customer)
SELECT k, CASE WHEN k % 5 <> 0 THEN substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2) || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) END AS mac,
  CASE WHEN k % 5 <> 0 AND substr(h, 2, 1) NOT IN ('2', '3', '6', '7', 'a', 'b', 'e', 'f') THEN upper(substr(h, 1, 6)) END AS oui FROM x""")  # fmt: skip
def mac_normalise(spark: SparkSession, folder: str) -> DataFrame:
    h, k = F.md5("c_name"), F.col("c_custkey")
    dotted = F.concat_ws(".", F.substring(F.upper(h), 1, 4), F.substring(h, 5, 4), F.substring(h, 9, 4))
    raw = F.when(k % 5 == 0, F.substring(h, 1, 11)).when(k % 2 == 0, dotted).otherwise(F.substring(h, 1, 12))
    return table(spark, folder, "customer").select(k.alias("k"), names.mac(raw).alias("mac"), names.oui(raw).alias("oui"))


@query("vlan_bitmap", """
WITH x AS (SELECT p_partkey AS k, substr(md5(p_name), 1, 8) AS h FROM part)
SELECT k, array_to_string(list_filter(range(0, 32), lambda i: (('0x' || h)::BIGINT >> (31 - i)) & 1 = 1), ',') AS vlans FROM x""")  # fmt: skip
def vlan_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    bits = network.vlan_bitmap(F.substring(F.md5("p_name"), 1, 8))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.array_join(bits.cast("array<string>"), ",").alias("vlans"))


@query("iso_epoch_ms", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 3 THEN epoch_ms(date_trunc('second', ts)) - 7200000 ELSE epoch_ms(date_trunc('second', ts)) END AS ms FROM events""")  # fmt: skip
def iso_epoch_ms(spark: SparkSession, folder: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("x"), text)).when(k == 1, text).when(k == 2, F.concat(text, F.lit("Z"))).otherwise(F.concat(text, F.lit("+02:00")))
    return table(spark, folder, "events").select("event_id", health.iso_ms(raw).alias("ms"))


@query("public_asn", """
WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN 64400 + o_orderkey % 1300 WHEN 2 THEN 4199999990 + o_orderkey % 30 ELSE 4294967280 + o_orderkey % 20 END AS asn FROM orders)
SELECT k, asn > 0 AND NOT asn BETWEEN 64496 AND 65551 AND asn < 4200000000 AS public FROM x""")  # fmt: skip
def public_asn(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    asn = F.when(k % 4 == 0, k).when(k % 4 == 1, 64400 + k % 1300).when(k % 4 == 2, 4199999990 + k % 30).otherwise(4294967280 + k % 20)
    return table(spark, folder, "orders").select(k.alias("k"), network.is_public_asn(asn).alias("public"))


@query("health_score", """
WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity * 2 AS ui, l_quantity * l_discount * 20 AS uo, CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 20 ELSE 0 END AS e, l_returnflag <> 'A' AS b FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN b THEN least(100, CASE WHEN greatest(ui, uo) >= 95 THEN 80 WHEN greatest(ui, uo) >= 80 THEN 50 WHEN greatest(ui, uo) >= 50 THEN 20 ELSE 0 END + CASE WHEN e >= 10 THEN 60 WHEN e >= 1 THEN 30 WHEN e > 0 THEN 10 ELSE 0 END) END AS score FROM x""")  # fmt: skip
def health_score(spark: SparkSession, folder: str) -> DataFrame:
    err = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 20).otherwise(0.0)
    score = health.interface_score(F.col("l_quantity") * 2, F.col("l_quantity") * F.col("l_discount") * 20, err, F.lit(0.0), F.col("l_returnflag") != "A")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", score.alias("score"))


@query("staleness_policy", """
WITH x AS (SELECT o_orderkey AS k, ['critical', 'warning'][o_orderkey % 2 + 1] AS severity, CASE WHEN o_orderkey % 7 > 0 THEN epoch_ms(o_orderdate) END AS last, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 86400 * 400 END::BIGINT AS t, ['info', 'filter', 'bogus', 'warning'][o_orderkey % 4 + 1] AS stale FROM orders),
y AS (SELECT *, last IS NOT NULL AND t > 0 AND 900000000000 - last > t * 1000 AS old FROM x)
SELECT k, CASE WHEN NOT old OR stale = 'bogus' THEN severity WHEN stale = 'filter' THEN NULL ELSE stale END AS severity FROM y""")  # fmt: skip
def staleness_policy(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    last = F.when(k % 7 > 0, F.unix_millis(F.col("o_orderdate").cast("timestamp")))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    out = health.staleness(pick("critical", "warning"), last, F.lit(900000000000), F.when(k % 5 == 0, 0).otherwise(86400 * 400), pick("info", "filter", "bogus", "warning"))
    return table(spark, folder, "orders").select(k.alias("k"), out.alias("severity"))


@query("ip_expressions", """
WITH x AS (SELECT s_suppkey AS k, 3232235520 + s_suppkey * 77 AS a FROM supplier)
SELECT k, (a >> 24) || '.' || ((a >> 16) & 255) || '.' || ((a >> 8) & 255) || '.' || (a & 255) AS address,
  ((a - a % 512) >> 24) || '.' || (((a - a % 512) >> 16) & 255) || '.' || (((a - a % 512) >> 8) & 255) || '.0/23' AS cidr, 23::BIGINT AS length FROM x""")  # fmt: skip
def ip_expressions(spark: SparkSession, folder: str) -> DataFrame:
    address = network.ipv4_text(F.lit(3232235520) + F.col("s_suppkey") * 77)
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), network.ipv4_text(network.ipv4(address)).alias("address"), network.cidr(address, F.lit(23)).alias("cidr"), network.netmask_length(F.lit("255.255.254.0")).cast("bigint").alias("length"))


@query("shard_targets", """
SELECT s_suppkey AS target, CAST(('0x' || substr(md5(s_name), 1, 16))::UBIGINT % 4 AS INTEGER) AS shard FROM supplier""")  # fmt: skip
def shard_targets(spark: SparkSession, folder: str) -> DataFrame:
    from netloom.operators.snmp import shard_of

    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("target"), shard_of(F.col("s_name"), 4).alias("shard"))


@query("shard_owners", """
SELECT s_name AS target, 'poller-' || ('0x' || substr(md5(s_name), 1, 16))::UBIGINT % 3 AS poller FROM supplier""")  # fmt: skip
def shard_owners(spark: SparkSession, folder: str) -> DataFrame:
    from netloom.operators.snmp import owners

    pollers = spark.createDataFrame([(f"poller-{k}",) for k in (2, 0, 1)], "poller string")
    return owners(table(spark, folder, "supplier").select(F.col("s_name").alias("target")), pollers)
