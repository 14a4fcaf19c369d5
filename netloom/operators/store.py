"""The property graph as two tables, maintained by snapshots.

Nodes are (id, type, props map<string,string>, source_adapter, first_seen,
last_seen, hash); edges are (src, dst, type, interface_a, interface_b, props,
source_adapter, first_seen, last_seen, hash). Every operation takes tables and
returns a table; times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Properties that change on every poll and don't count as content.
VOLATILE = ("health_updated_at", "last_polled_at")
#: Edge types without a direction.
UNDIRECTED = ("PHYSICAL_LINK", "STP_LINK", "ROUTING_PEER")
NODE_KEY = ["type", "id"]
EDGE_KEY = ["type", "src", "dst", "interface_a", "interface_b"]


def canonical_json(props: Column) -> Column:
    """Properties as JSON in the order of their names, nulls and volatile ones left out."""
    kept = F.map_filter(props, lambda k, v: v.isNotNull() & ~k.isin(*VOLATILE))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def content_hash(*columns: Column, props: Column) -> Column:
    return F.sha1(F.concat_ws("|", *columns, canonical_json(props)))


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges from the lower to the higher id; properties that end in
    _a and _b change sides with their ends."""
    swap = F.col("type").isin(*UNDIRECTED) & (F.col("src") > F.col("dst"))
    side = lambda k: F.when(k.endswith("_a"), F.concat(F.substr(k, F.lit(1), F.length(k) - 1), F.lit("b"))).when(k.endswith("_b"), F.concat(F.substr(k, F.lit(1), F.length(k) - 1), F.lit("a"))).otherwise(k)
    props = F.when(swap, F.transform_keys("props", lambda k, _: side(k))).otherwise(F.col("props")) if "props" in edges.columns else None
    turned = {"src": F.least("src", "dst"), "dst": F.greatest("src", "dst"), "interface_a": F.col("interface_b"), "interface_b": F.col("interface_a")}
    return edges.withColumns({k: F.when(swap, v).otherwise(F.col(k)) for k, v in turned.items()} | ({"props": props} if props is not None else {}))


def _merged(old: Column, new: Column) -> Column:
    """``old += new``: new values replace, nulls remove, others stay."""
    old, fresh = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k)), F.map_filter(fresh, lambda _, v: v.isNotNull()))


def _upsert(old: DataFrame, new: DataFrame, key: list[str], now_ms: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Full outer join of the stored rows and a snapshot. ``change`` tells what
    became of each: created, updated (other content), touched or absent."""
    o, n = old.alias("o"), new.alias("n")
    # the hash of the key leads, so that the join's sorts compare a number
    on = [_hashed(*(f"o.{k}" for k in key)) == _hashed(*(f"n.{k}" for k in key)), *(F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key)]
    seen, known = F.col("n.hash").isNotNull(), F.col("o.hash").isNotNull()
    same = F.col("o.hash") == F.col("n.hash")
    change = F.when(~seen, "absent").when(~known, "created").when(same, "touched").otherwise("updated")
    props = F.when(seen & ~F.coalesce(same, F.lit(False)), _merged(F.col("o.props"), F.col("n.props"))).otherwise(F.col("o.props"))
    columns = [
        *(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key),
        props.alias("props"),
        F.coalesce("n.source_adapter", "o.source_adapter").alias("source_adapter"),
        F.coalesce("o.first_seen", F.lit(now_ms)).alias("first_seen"),
        F.when(seen, F.lit(now_ms)).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.coalesce("n.hash", "o.hash").alias("hash"),
        change.alias("change"),
        *((v.alias(k)) for k, v in (extra or {}).items()),
    ]
    return o.join(n, on, "full_outer").select(*columns)


def with_node_hash(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("hash", content_hash(F.col("type"), F.col("id"), props=F.col("props")))


def with_edge_hash(edges: DataFrame) -> DataFrame:
    return edges.withColumn("hash", content_hash(*(F.coalesce(c, F.lit("")) for c in EDGE_KEY), props=F.col("props")))


def _hashed(*key: str) -> Column:
    return F.xxhash64(*(F.col(k).cast("string") for k in key))


def _folded(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the properties of all its rows, laid over each other
    in the order of their sources (of equal sources, of their contents), a null
    removes; and the last source. Equal rows are combined first; where a key
    then has several, a property at a time, so keys of very many rows are
    combined before they are shuffled."""
    different = rows.select(*key, "source_adapter", F.map_entries("props").alias("_entries")).distinct().withColumn("_key", _hashed(*key))
    mixed = different.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    none = F.array().cast("array<struct<key:string,value:string>>")
    alone = different.join(mixed, "_key", "left_anti").select(*key, F.map_from_entries(F.array_sort(F.coalesce("_entries", none))).alias("props"), "source_adapter")
    several = different.join(mixed, "_key", "left_semi")
    each = several.select(*key, "source_adapter", canonical_json(F.map_from_entries("_entries")).alias("_json"), F.explode_outer("_entries").alias("_e"))
    order = F.struct("source_adapter", "_json")
    one = each.groupBy(*key, F.col("_e.key").alias("_name")).agg(F.max_by("_e.value", order).alias("_value"), F.max("source_adapter").alias("source_adapter"))
    named = F.collect_list(F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("key"), F.col("_value").alias("value"))))
    return alone.union(one.groupBy(*key).agg(F.map_from_entries(F.array_sort(named)).alias("props"), F.max("source_adapter").alias("source_adapter")))


def upsert_nodes(old: DataFrame, snapshot: DataFrame, now_ms: int) -> DataFrame:
    """The node table after a snapshot(id, type, props, source_adapter). Rows
    with one key are laid over each other in the order of their sources. A device whose status changes
    gets ``status_changed_at``."""
    new = with_node_hash(_folded(snapshot, NODE_KEY))
    before, after = F.col("o.props")["status"], F.col("n.props")["status"]
    moved = (F.coalesce("n.type", "o.type") == "Device") & after.isNotNull() & F.col("o.hash").isNotNull() & ~before.eqNullSafe(after)
    stamped = F.when(moved, F.lit(now_ms)).otherwise(F.col("o.status_changed_at"))
    return _upsert(old, new, NODE_KEY, now_ms, {"status_changed_at": stamped})


def upsert_edges(old: DataFrame, snapshot: DataFrame, nodes: DataFrame, now_ms: int) -> DataFrame:
    """The edge table after a snapshot(src, dst, type, interface_a, interface_b,
    props, source_adapter). Edges with an unknown end are dropped; undirected
    ones are oriented; interfaces tell only physical links apart."""
    cable = F.col("type") == "PHYSICAL_LINK"
    rows = oriented(snapshot).withColumns({c: F.when(cable, F.coalesce(c, F.lit(""))) for c in ("interface_a", "interface_b")})
    known = nodes.select("id").distinct()
    rows = rows.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    new = with_edge_hash(_folded(rows, EDGE_KEY))
    return _upsert(old, new, EDGE_KEY, now_ms)


def family(adapter: Column) -> Column:
    """``meraki`` of ``meraki/branch``."""
    return F.split(adapter, "/")[0]


def purge(edges: DataFrame, snapshot: DataFrame, adapter: str, every_type: bool = False) -> DataFrame:
    """``edges`` without those that the adapter (or its family) owns and its
    snapshot no longer has. Types that the snapshot lacks altogether are kept
    unless ``every_type``. Redirected edges count as their first owner's."""
    own = F.coalesce(F.col("props")["original_source_adapter"], F.col("source_adapter")) if "props" in edges.columns else F.col("source_adapter")
    mine = F.coalesce(own.isin(adapter, adapter.split("/")[0]), F.lit(False))
    scope = mine if every_type else mine & F.col("_present")
    present = snapshot.select("type").distinct().withColumn("_present", F.lit(True))
    kept = oriented(snapshot).select(*EDGE_KEY).withColumns({c: F.coalesce(c, F.lit("")) for c in EDGE_KEY[3:]}).distinct().withColumn("_kept", F.lit(True))
    keys = edges.withColumns({f"_{c}": F.coalesce(c, F.lit("")) for c in EDGE_KEY[3:]})
    kept = kept.withColumnsRenamed({c: f"_{c}" for c in EDGE_KEY[3:]})
    marked = keys.join(F.broadcast(present), "type", "left").join(kept, ["type", "src", "dst", "_interface_a", "_interface_b"], "left")
    gone = F.coalesce(scope, F.lit(False)) & F.col("_kept").isNull()
    return marked.where(~gone).select(*edges.columns)


def merge(*snapshots: DataFrame) -> DataFrame:
    """Concatenation of snapshots, whatever columns each has."""
    out, *rest = snapshots
    for x in rest:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge once from either end: (src, dst, ...)."""
    back = [c for c in columns]
    return edges.select("src", "dst", *columns).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *back))
