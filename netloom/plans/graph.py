"""The star-schema tables seen as a network graph.

Customers and suppliers are devices, nations platform sites, regions sites;
order lines link a customer to a supplier over an interface named after the
line number; events are observations of users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def devices(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, source_adapter, nation, balance, role, status)"""
    c = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("c").alias("source_adapter"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("role"))
    s = table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("s").alias("source_adapter"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("SUPPLIER").alias("role"))
    return c.union(s).withColumn("status", F.when(F.col("balance") < 0, "down").when(F.col("balance") < 1000, "alerting").otherwise("active"))


DEVICES = """devices AS (
  SELECT *, CASE WHEN balance < 0 THEN 'down' WHEN balance < 1000 THEN 'alerting' ELSE 'active' END AS status FROM (
    SELECT 'c' || c_custkey AS id, c_name AS name, 'c' AS source_adapter, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS role FROM customer
    UNION ALL SELECT 's' || s_suppkey, s_name, 's', s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier))"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their order's columns: src the customer, dst the supplier."""
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumns({"src": F.concat(F.lit("c"), "o_custkey"), "dst": F.concat(F.lit("s"), "l_suppkey")})


LINES = """lines AS (SELECT *, 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def topology(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that any order line links, once each."""
    return lines(spark, folder).select("src", "dst").distinct()


STEPS = f"{LINES}, pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM lines), steps AS MATERIALIZED (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs)"


def links(spark: SparkSession, folder: str) -> DataFrame:
    """(rid, src, dst, interface_a, interface_b, proto, confidence) of the order lines."""
    proto = F.element_at(F.array(*map(F.lit, ("lldp", "cdp", "mac_correlation", "arp_correlation", "catc_topology"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = lines(spark, folder).select(
        (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("rid"), "src", "dst",
        F.concat(F.lit("Gi0/"), "l_linenumber").alias("interface_a"), F.concat(F.lit("Eth1/"), F.col("l_partkey") % 4).alias("interface_b"),
        proto.alias("proto"), (F.col("l_quantity") / 100).alias("confidence"),
    )
    return rows.groupBy("rid").agg(*(F.min(c).alias(c) for c in rows.columns[1:]))


LINKS = f"""{LINES}, links AS (
  SELECT rid, min(src) AS src, min(dst) AS dst, min(interface_a) AS interface_a, min(interface_b) AS interface_b, min(proto) AS proto, min(confidence) AS confidence FROM (
    SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS rid, src, dst, 'Gi0/' || l_linenumber AS interface_a, 'Eth1/' || (l_partkey % 4) AS interface_b,
      ['lldp', 'cdp', 'mac_correlation', 'arp_correlation', 'catc_topology'][l_partkey % 5 + 1] AS proto, l_quantity / 100 AS confidence
    FROM lines) GROUP BY rid)"""


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """(element, at, state, value) of the events; at in milliseconds."""
    return table(spark, folder, "events").select(F.col("user_id").alias("element"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("state"), "value", "event_id")


OBSERVATIONS = "observations AS (SELECT user_id AS element, epoch_us(ts) // 1000 AS at_ms, event_type AS state, value, event_id FROM events)"
