"""Merging stubs, devices known by their neighbours only, into real ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import host_label

_NONE = "array<string>"


def by_mac(stubs: DataFrame, owned: DataFrame) -> DataFrame:
    """(stub, canonical) by ``stubs(id, chassis_mac)`` and ``owned(device, mac)``; the least device of several."""
    rows = stubs.select(F.col("id").alias("stub"), F.lower("chassis_mac").alias("mac")).join(owned.select("device", F.lower("mac").alias("mac")), "mac")
    return rows.where("stub <> device").groupBy("stub").agg(F.min("device").alias("canonical"))


def by_ip(stubs: DataFrame, addresses: DataFrame, candidates: DataFrame) -> DataFrame:
    """(stub, canonical) by ``stubs(id, mgmt_ip)``: the device of the address
    (``addresses(ip, device)``), else one that names it among its own
    (``candidates(id, candidate_ips)``)."""
    wanted = stubs.select(F.col("id").alias("stub"), F.col("mgmt_ip").alias("ip")).where("ip <> ''")
    first = wanted.join(addresses, "ip").where("stub <> device").groupBy("stub").agg(F.min("device").alias("first"))
    listed = candidates.select(F.col("id").alias("device"), F.explode("candidate_ips").alias("ip"))
    second = wanted.join(listed, "ip").where("stub <> device").groupBy("stub").agg(F.min("device").alias("second"))
    return first.join(second, "stub", "full_outer").select("stub", F.coalesce("first", "second").alias("canonical"))


def by_name(stubs: DataFrame, real: DataFrame) -> DataFrame:
    """(stub, canonical) by the first label of ``stubs(id, name, discovered_via)``
    among ``real(id, name[, candidate_names])``; stubs without a real device are
    grouped by label under the one with discovered_via, then the least id."""
    names = F.array(F.col("name")) if "candidate_names" not in real.columns else F.concat(F.array("name"), F.coalesce("candidate_names", F.array().cast(_NONE)))
    known = real.select("id", F.explode(names).alias("name")).groupBy(host_label(F.col("name")).alias("label")).agg(F.min("id").alias("real_id")).where("label is not null")
    rows = stubs.withColumn("label", host_label(F.col("name"))).join(known, "label", "left").where("real_id is null or real_id <> id")
    order = [F.desc(F.col("discovered_via").isNotNull()), "id"]
    among = rows.where("real_id is null and label is not null").withColumn("first", F.first("id").over(Window.partitionBy("label").orderBy(*order)))
    return rows.where("real_id is not null").select(F.col("id").alias("stub"), F.col("real_id").alias("canonical")).union(among.where("id <> first").select("id", "first"))


def priority(*mappings: DataFrame) -> DataFrame:
    """The first of several (stub, canonical) tables that has a stub."""
    rows = None
    for k, m in enumerate(mappings):
        part = m.select("stub", "canonical", F.lit(k).alias("_k"))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("stub").agg(F.min_by("canonical", F.struct("_k", "canonical")).alias("canonical"))


def absorb(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges`` with stubs' physical links moved to their real devices: links to
    oneself go, links of equal ends and interfaces are one, the first source by
    name stays. A moved link remembers its source."""
    to = mapping.groupBy("stub").agg(F.min("canonical").alias("canonical"))
    cable = F.col("type") == "PHYSICAL_LINK"
    rows = edges.join(to.select(F.col("stub").alias("src"), F.col("canonical").alias("_s")), "src", "left").join(to.select(F.col("stub").alias("dst"), F.col("canonical").alias("_d")), "dst", "left")
    moved = cable & (F.col("_s").isNotNull() | F.col("_d").isNotNull())
    rows = rows.withColumns({"src": F.when(cable, F.coalesce("_s", "src")).otherwise(F.col("src")), "dst": F.when(cable, F.coalesce("_d", "dst")).otherwise(F.col("dst")), "moved": moved}).where("src <> dst").drop("_s", "_d")
    one = Window.partitionBy("type", "src", "dst", F.coalesce("interface_a", F.lit("")), F.coalesce("interface_b", F.lit(""))).orderBy("moved", "source_adapter")
    return rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def tombstoned(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Merged stubs stay, marked with the device they stand for."""
    to = mapping.select(F.col("stub").alias("id"), F.col("canonical").alias("canonical_id"))
    return nodes.drop("canonical_id").join(to, "id", "left").withColumn("tombstoned", F.col("canonical_id").isNotNull())


def rehome(stubs: DataFrame, neighbors: DataFrame, located: DataFrame) -> DataFrame:
    """(id, site) of ``stubs(id)`` whose neighbours(id, other) are all at one site of ``located(id, site)``."""
    sites = neighbors.join(stubs, "id", "left_semi").join(located.withColumnRenamed("id", "other"), "other")
    return sites.groupBy("id").agg(F.count_distinct("site").alias("n"), F.min("site").alias("site")).where("n = 1").drop("n")


def best_name(names: Column) -> Column:
    return F.array_min(F.filter(names, lambda x: x != ""))
