"""Server fabrics: interconnects, servers and the cables between them.

Objects refer to each other by id. A server's port names the interconnect's
port it is cabled to; that port knows its domain and side only, which together
name the interconnect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.names import fi_port, host_port, mac

SCHEMAS = {
    "fi": "Moid string, Model string, Serial string, SwitchId string, Name string, Dn string, ManagementIpAddress string, OutOfBandMac string, OperState string, RegisteredDevice struct<Moid: string>",
    "server": "name string, platform string, platform_id string, role string, serial string, mgmt_ip string, platform_metadata map<string,string>",
    "adapter": "Moid string, Model string, Pid string, ComputeNode struct<Moid: string>",
    "phy_port": "Moid string, SlotId int, PortId int, SwitchId string, Dn string, Role string, RegisteredDevice struct<Moid: string>",
    "ext_eth": "Moid string, SlotId int, PortId int, MacAddress string, AcknowledgedPeerInterface struct<ObjectType: string, Moid: string>, AdapterUnit struct<Moid: string>, RegisteredDevice struct<Moid: string>",
}


def _id(kind: str, instance: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:{instance}:"), key)


def identities(fi: DataFrame, instance: str) -> DataFrame:
    """(id, name, serial, mgmt_ip, candidate_ips, candidate_names, mac): what
    neighbours may know an interconnect by."""
    some = lambda *c: F.array_distinct(F.filter(F.array(*c), lambda x: x.isNotNull() & (x != "")))
    side = F.when(F.col("SwitchId") != "", F.concat(F.lit("FI-"), F.col("SwitchId")))
    names = some(F.col("Name"), F.col("SwitchId"), side, F.col("Dn"))
    return fi.select(_id("intersight-fi", instance, F.col("Moid")).alias("id"), F.coalesce("Name", side).alias("name"), F.col("Serial").alias("serial"), F.col("ManagementIpAddress").alias("mgmt_ip"), some(F.col("ManagementIpAddress")).alias("candidate_ips"), names.alias("candidate_names"), mac(F.col("OutOfBandMac")).alias("mac"))


def cables(fi: DataFrame, server: DataFrame, adapter: DataFrame, phy_port: DataFrame, ext_eth: DataFrame, instance: str) -> DataFrame:
    """(src, dst, interface_a, interface_b, mac_address, discovery_proto, link_type).

    One link for each cabled port. A server without any gets a link without
    ports to each interconnect of its own domain.
    """
    ports = ext_eth.where("AcknowledgedPeerInterface.ObjectType = 'ether.PhysicalPort'").select(F.col("AcknowledgedPeerInterface.Moid").alias("peer"), F.col("AdapterUnit.Moid").alias("unit"), host_port(F.col("SlotId"), F.col("PortId")).alias("interface_a"), F.col("MacAddress").alias("mac_address"))
    peers = phy_port.select(F.col("Moid").alias("peer"), F.col("RegisteredDevice.Moid").alias("domain"), F.col("SwitchId").alias("side"), fi_port(F.col("SlotId"), F.col("PortId")).alias("interface_b"))
    sides = fi.select(F.col("RegisteredDevice.Moid").alias("domain"), F.col("SwitchId").alias("side"), F.col("Moid").alias("fi"))
    units = adapter.select(F.col("Moid").alias("unit"), F.col("ComputeNode.Moid").alias("server"))
    known = server.select(F.col("platform_id").alias("server"), F.element_at("platform_metadata", "device_moid").alias("domain"))
    cabled = ports.join(peers, "peer").join(sides, ["domain", "side"]).join(units, "unit").join(known.select("server"), "server", "left_semi").select("server", "fi", "interface_a", "interface_b", "mac_address")
    rest = known.join(cabled.select("server").distinct(), "server", "left_anti").join(sides, "domain")
    rest = rest.select("server", "fi", F.lit("").alias("interface_a"), F.lit("").alias("interface_b"), F.lit(None).cast("string").alias("mac_address"))
    return cabled.union(rest).select(_id("intersight", instance, F.col("server")).alias("src"), _id("intersight-fi", instance, F.col("fi")).alias("dst"), "interface_a", "interface_b", "mac_address", F.lit("intersight").alias("discovery_proto"), F.lit("server_to_fi").alias("link_type"))
