"""Queries over snapshots of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import reconcile, store
from netloom.plans.catalog import query
from netloom.plans.graph import DEVICES, LINES, devices, lines, table

NOW = 1_700_000_000_000
_EMPTY = "map<string,string>"


def _snapshot(spark: SparkSession, folder: str, second: bool) -> DataFrame:
    """Parts as nodes: A without every tenth, B without every seventh and with every third resized."""
    p = table(spark, folder, "part").where("p_partkey % 7 <> 0" if second else "p_partkey % 10 <> 0")
    size = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")) if second else F.col("p_size")
    props = F.create_map(F.lit("brand"), "p_brand", F.lit("size"), size.cast("string"), F.lit("status"), F.when(size > 25, "up").otherwise("down"))
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("Device").alias("type"), props.alias("props"), F.lit("meraki/x").alias("source_adapter"))


def _no_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, type string, props map<string,string>, source_adapter string, first_seen bigint, last_seen bigint, hash string, status_changed_at bigint")


def _no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "type string, src string, dst string, interface_a string, interface_b string, props map<string,string>, source_adapter string, first_seen bigint, last_seen bigint, hash string")


_SIZES = """a AS (SELECT p_partkey AS k, p_size AS size FROM part WHERE p_partkey % 10 <> 0),
b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 7 <> 0)"""


@query("node_upsert", f"""
WITH {_SIZES}
SELECT 'part:' || k AS id, coalesce(b.size, a.size) AS size, CASE WHEN a.size IS NULL THEN {NOW + 1} ELSE {NOW} END AS first_seen,
  CASE WHEN b.size IS NULL THEN {NOW} ELSE {NOW + 1} END AS last_seen,
  CASE WHEN b.size IS NULL THEN 'absent' WHEN a.size IS NULL THEN 'created' WHEN a.size = b.size THEN 'touched' ELSE 'updated' END AS change,
  CASE WHEN (a.size > 25) <> (b.size > 25) THEN {NOW + 1} END AS status_changed_at
FROM a FULL JOIN b USING (k)""")  # fmt: skip
def node_upsert(spark: SparkSession, folder: str) -> DataFrame:
    first = store.upsert_nodes(_no_nodes(spark), _snapshot(spark, folder, False), NOW).drop("change")
    both = store.upsert_nodes(first, _snapshot(spark, folder, True), NOW + 1)
    return both.select("id", F.col("props")["size"].cast("int").alias("size"), "first_seen", "last_seen", "change", "status_changed_at")


@query("content_hash_skip", f"""
WITH {_SIZES}
SELECT CASE WHEN a.size = b.size THEN 'unchanged' ELSE 'changed' END AS kind, count(*) AS n FROM a JOIN b USING (k) GROUP BY 1""")  # fmt: skip
def content_hash_skip(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (store.with_node_hash(_snapshot(spark, folder, x)).select("id", F.col("hash").alias(h)) for x, h in ((False, "a"), (True, "b")))
    return a.join(b, "id").groupBy(F.when(F.col("a") == F.col("b"), "unchanged").otherwise("changed").alias("kind")).agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, folder: str, where: str) -> DataFrame:
    """Order lines as cables, from the supplier on even lines; most have known ends."""
    rows = lines(spark, folder).where(where)
    swap = F.col("l_linenumber") % 2 == 0
    a, b = F.concat(F.lit("Gi"), "l_linenumber"), F.concat(F.lit("Te"), F.col("l_partkey") % 3)
    return rows.select(
        F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"),
        F.when(F.col("l_partkey") % 2 == 0, "PHYSICAL_LINK").otherwise("ROUTES_TO").alias("type"),
        F.when(swap, b).otherwise(a).alias("interface_a"), F.when(swap, a).otherwise(b).alias("interface_b"),
        F.create_map(F.lit("kind"), F.lit("x")).alias("props"), F.lit("meraki/x").alias("source_adapter"),
    )


def _edges_sql(name: str, where: str) -> str:
    raw = f"""SELECT CASE WHEN l_linenumber % 2 = 0 THEN dst ELSE src END AS s, CASE WHEN l_linenumber % 2 = 0 THEN src ELSE dst END AS d,
    CASE WHEN l_partkey % 2 = 0 THEN 'PHYSICAL_LINK' ELSE 'ROUTES_TO' END AS type,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Te' || (l_partkey % 3) ELSE 'Gi' || l_linenumber END AS ia, CASE WHEN l_linenumber % 2 = 0 THEN 'Gi' || l_linenumber ELSE 'Te' || (l_partkey % 3) END AS ib
    FROM lines WHERE {where}"""
    return f"""{name} AS (SELECT DISTINCT type,
    CASE WHEN type = 'PHYSICAL_LINK' THEN least(s, d) ELSE s END AS src, CASE WHEN type = 'PHYSICAL_LINK' THEN greatest(s, d) ELSE d END AS dst,
    CASE WHEN type = 'PHYSICAL_LINK' THEN CASE WHEN s > d THEN ib ELSE ia END END AS interface_a, CASE WHEN type = 'PHYSICAL_LINK' THEN CASE WHEN s > d THEN ia ELSE ib END END AS interface_b
    FROM ({raw}))"""


_KNOWN = "CAST(substr({0}, 2) AS BIGINT) % 11 <> 0"


@query("edge_upsert", f"""
WITH {LINES}, {_edges_sql("a", "l_orderkey % 3 <> 0")}, {_edges_sql("b", "l_suppkey % 5 <> 0")},
x AS (SELECT * FROM a WHERE {_KNOWN.format("src")} AND {_KNOWN.format("dst")}), y AS (SELECT * FROM b WHERE {_KNOWN.format("src")} AND {_KNOWN.format("dst")})
SELECT coalesce(x.type, y.type) AS type, coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, coalesce(x.interface_a, y.interface_a) AS interface_a, coalesce(x.interface_b, y.interface_b) AS interface_b,
  CASE WHEN y.type IS NULL THEN 'absent' WHEN x.type IS NULL THEN 'created' ELSE 'touched' END AS change
FROM x FULL JOIN y ON x.type = y.type AND x.src = y.src AND x.dst = y.dst AND coalesce(x.interface_a, '') = coalesce(y.interface_a, '') AND coalesce(x.interface_b, '') = coalesce(y.interface_b, '')""")  # fmt: skip
def edge_upsert(spark: SparkSession, folder: str) -> DataFrame:
    nodes = devices(spark, folder).select("id").where("cast(substr(id, 2) as bigint) % 11 <> 0")
    first = store.upsert_edges(_no_edges(spark), _edges(spark, folder, "l_orderkey % 3 <> 0"), nodes, NOW).drop("change")
    return store.upsert_edges(first, _edges(spark, folder, "l_suppkey % 5 <> 0"), nodes, NOW + 1).select(*store.EDGE_KEY, "change")


@query("diff_purge", f"""
WITH {LINES}, {_edges_sql("a", "l_orderkey % 3 <> 0")}, {_edges_sql("b", "l_suppkey % 5 <> 0 AND l_partkey % 2 = 0")}
SELECT * FROM a WHERE type = 'ROUTES_TO' OR EXISTS (SELECT 1 FROM b WHERE b.type = a.type AND b.src = a.src AND b.dst = a.dst AND b.interface_a = a.interface_a AND b.interface_b = a.interface_b)""")  # fmt: skip
def diff_purge(spark: SparkSession, folder: str) -> DataFrame:
    nodes = devices(spark, folder).select("id")
    stored = store.upsert_edges(_no_edges(spark), _edges(spark, folder, "l_orderkey % 3 <> 0"), nodes, NOW)
    return store.purge(stored, _edges(spark, folder, "l_suppkey % 5 <> 0 AND l_partkey % 2 = 0"), "meraki/x").select(*store.EDGE_KEY)


@query("canonical_orientation", f"""
WITH {LINES}, {_edges_sql("a", "true")} SELECT * FROM a""")  # fmt: skip
def canonical_orientation(spark: SparkSession, folder: str) -> DataFrame:
    cable = F.col("type") == "PHYSICAL_LINK"
    rows = store.oriented(_edges(spark, folder, "true"))
    return rows.select("type", "src", "dst", *(F.when(cable, F.col(c)).alias(c) for c in ("interface_a", "interface_b"))).distinct()


@query("intent_delta", f"""
WITH {DEVICES}, x AS (SELECT id, name, CASE WHEN hash % 4 = 0 THEN upper(name) || '.example.net' WHEN hash % 4 = 1 THEN 'other-' || id WHEN hash % 4 = 2 THEN name ELSE NULL END AS now_name,
  'sn' || id AS serial, CASE WHEN hash % 3 = 0 THEN 'SN' || upper(id) WHEN hash % 3 = 1 THEN 'OLD' ELSE NULL END AS now_serial
  FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS hash FROM devices))
SELECT id, CASE WHEN split_part(lower(name), '.', 1) <> split_part(lower(now_name), '.', 1) THEN now_name END AS name_delta, CASE WHEN upper(serial) <> upper(now_serial) THEN now_serial END AS serial_delta FROM x""")  # fmt: skip
def intent_delta(spark: SparkSession, folder: str) -> DataFrame:
    k = F.substr("id", F.lit(2)).cast("bigint")
    now = F.when(k % 4 == 0, F.concat(F.upper("name"), F.lit(".example.net"))).when(k % 4 == 1, F.concat(F.lit("other-"), "id")).when(k % 4 == 2, F.col("name"))
    serial = F.when(k % 3 == 0, F.concat(F.lit("SN"), F.upper("id"))).when(k % 3 == 1, "OLD")
    rows = devices(spark, folder).select("id", F.col("name").alias("intent_name"), now.alias("current_name"), F.concat(F.lit("sn"), "id").alias("intent_serial"), serial.alias("current_serial"))
    delta = reconcile.delta(F.col("intent_name"), F.col("current_name"), F.col("intent_serial"), F.col("current_serial"))
    return rows.select("id", F.try_element_at(delta, F.lit("name"))["current"].alias("name_delta"), F.try_element_at(delta, F.lit("serial"))["current"].alias("serial_delta"))


@query("reconcile_missing", """
SELECT DISTINCT l_suppkey AS device, 'Gi' || l_linenumber || '/' || l_partkey % 50 AS name FROM lineitem WHERE l_quantity > 45
EXCEPT SELECT DISTINCT l_suppkey, 'Gi' || l_linenumber || '/' || l_partkey % 50 FROM lineitem WHERE l_discount > 0.05 AND l_quantity <= 20""")  # fmt: skip
def reconcile_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("device"), F.concat(F.lit("Gi"), "l_linenumber", F.lit("/"), F.col("l_partkey") % 50).alias("name"), "l_quantity", "l_discount")
    return reconcile.missing_interfaces(rows.where("l_quantity > 45"), rows.where("l_discount > 0.05 and l_quantity <= 20").withColumn("name", F.upper("name")))


@query("absent_devices", f"""
WITH {DEVICES} SELECT id, name FROM devices WHERE NOT EXISTS (SELECT 1 FROM orders WHERE 'c' || o_custkey = id AND o_orderpriority = '1-URGENT') AND source_adapter = 'c'""")  # fmt: skip
def absent_devices(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), "o_custkey").alias("id"))
    return reconcile.absent(devices(spark, folder).where("source_adapter = 'c'").select("id", "name"), seen)


@query("priority_match", f"""
WITH {DEVICES}, intent AS (SELECT s_suppkey AS k, 's' || s_suppkey AS serial, lower(s_name) AS name FROM supplier),
seen AS (SELECT id AS node, CASE WHEN balance > 3000 THEN upper(id) END AS serial, upper(name) || '.x.net' AS name FROM devices)
SELECT i.k, coalesce((SELECT min(node) FROM seen s WHERE lower(s.serial) = i.serial), (SELECT min(node) FROM seen s WHERE split_part(lower(s.name), '.', 1) = i.name)) AS node FROM intent i""")  # fmt: skip
def priority_match(spark: SparkSession, folder: str) -> DataFrame:
    intent = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("s"), "s_suppkey").alias("serial"), F.col("s_name").alias("name"))
    seen = devices(spark, folder).select(F.col("id").alias("node"), F.when(F.col("balance") > 3000, F.upper("id")).alias("serial"), F.concat(F.upper("name"), F.lit(".x.net")).alias("name"))
    return reconcile.match(intent, seen, "k").select("k", "node")


@query("site_mapping_priority", """
WITH p AS (SELECT n_nationkey AS ps, n_name AS name FROM nation), s AS (SELECT n_nationkey AS site, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'The ' || n_name END AS name, lower(n_name) AS slug FROM nation WHERE n_nationkey % 3 <> 0),
e AS (SELECT n_nationkey AS ps, (n_nationkey + 1) % 25 AS site FROM nation WHERE n_nationkey % 5 = 0),
b AS (SELECT ps, min(site) AS site FROM p JOIN s ON regexp_replace(lower(p.name), '[^a-z0-9]+', '-', 'g') = s.slug WHERE ps NOT IN (SELECT ps FROM e) GROUP BY ps),
c AS (SELECT ps, min(site) AS site FROM p JOIN s ON regexp_replace(lower(p.name), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(s.name), '[^a-z0-9]+', '', 'g') WHERE ps NOT IN (SELECT ps FROM e) AND ps NOT IN (SELECT ps FROM b) GROUP BY ps)
SELECT ps, site, 'explicit' AS method, 1.0::DOUBLE AS confidence FROM e UNION ALL SELECT ps, site, 'slug', 1.0 FROM b UNION ALL SELECT ps, site, 'name', 0.9 FROM c""")  # fmt: skip
def site_mapping_priority(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "nation")
    platform = n.select(F.col("n_nationkey").alias("ps"), F.col("n_name").alias("name"))
    named = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("The "), "n_name"))
    sites = n.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("site"), named.alias("name"), F.lower("n_name").alias("slug"))
    explicit = n.where("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("ps"), ((F.col("n_nationkey") + 1) % 25).alias("site"))
    return reconcile.map_sites(platform, sites, explicit)
