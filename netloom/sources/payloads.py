"""Readers of exported inventories: JSON lines, one folder for each kind of object."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.network import ensure_cidr, is_useful_ip


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects below ``path``; a kind that wasn't exported is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pushed payloads as they arrive, one JSON object a line."""
    return spark.readStream.schema(schema).json(path)


def first_wins(key: Column, *sources: DataFrame) -> DataFrame:
    """The rows of all sources, of equal keys the one of the first source that
    has it (any of several within a source: the smallest). Null keys go."""
    every = None
    for k, source in enumerate(sources):
        rows = source.select(key.alias("_key"), F.lit(k).alias("_rank"), F.struct(*source.columns).alias("_row"))
        every = rows if every is None else every.unionByName(rows)
    kept = every.where("_key is not null").groupBy("_key").agg(F.min(F.struct("_rank", "_row")).alias("_first"))
    return kept.select("_first._row.*")


def prefixes(*sources: DataFrame) -> DataFrame:
    """Prefix tables ``(cidr, ...)`` in order of trust, hosts with their full length."""
    return first_wins(F.col("cidr"), *(s.withColumn("cidr", ensure_cidr(F.trim("cidr"))) for s in sources))


def clients(organisation: DataFrame, networks: DataFrame) -> DataFrame:
    """Clients ``(id, mac, ...)`` of the whole organisation as they are; where it
    lists none, those of its networks, once for each id or address."""
    fallback = first_wins(F.coalesce("id", "mac"), networks)
    none = organisation.limit(1).agg((F.count("*") == 0).alias("_none"))
    return organisation.unionByName(fallback.join(F.broadcast(none), F.col("_none")).select(*organisation.columns))


def elected_address(devices: DataFrame, vlans: DataFrame) -> DataFrame:
    """``devices(id, network, is_gateway, vpn_ip, wan_ip)`` with mgmt_ip and
    candidate_ips. A gateway has its network's address in the VLAN of the lowest
    number (``vlans(network, vid, appliance_ip)``), else its tunnel's, else its
    uplink's; other devices have the uplink's. Useless addresses don't count."""
    useful = lambda c: F.when(is_useful_ip(c), c)
    inner = vlans.withColumn("ip", useful(F.col("appliance_ip"))).where("ip is not null").groupBy("network").agg(F.min_by("ip", "vid").alias("_inner"))
    order = [F.when(F.col("is_gateway"), F.col("_inner")), F.when(F.col("is_gateway"), useful(F.col("vpn_ip"))), useful(F.col("wan_ip"))]
    every = F.array_distinct(F.array_compact(F.array(*order)))
    return devices.join(inner, "network", "left").withColumns({"mgmt_ip": F.coalesce(*order), "candidate_ips": every}).drop("_inner")


def first_parent(*levels: Column) -> Column:
    """The nearest container that is known: host, else cluster, else data centre."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in levels))


def first_useful(addresses: Column) -> Column:
    return F.try_element_at(F.filter(addresses, is_useful_ip), F.lit(1))


def all_addresses(*single: Column, nested: Column) -> Column:
    """Flat fields first, then a nested list; each address once, blanks left out."""
    found = F.concat(F.array(*single), F.coalesce(nested, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (F.trim(x) != "")))


def detailed(summary: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """``summary`` with the fields of ``detail`` where that has them."""
    own = detail.select(F.col(key).alias("_key"), F.struct(*detail.columns).alias("_detail"))
    names = set(detail.columns)
    value = lambda c: F.coalesce(F.col("_detail")[c], F.col(c)) if c in names and c != key else F.col(c)
    return summary.join(own, F.col(key) == F.col("_key"), "left").select(*(value(c).alias(c) for c in summary.columns))
