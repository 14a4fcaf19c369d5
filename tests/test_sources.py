from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.sources import fabric, payloads


def rows(spark: SparkSession, kind: str, values: list[dict]) -> DataFrame:
    return spark.createDataFrame(values, fabric.SCHEMAS[kind])


def parts(spark: SparkSession, cabled: bool, domain: str = "own-controller") -> dict[str, DataFrame]:
    side = lambda x, n: {"Moid": f"fi-{x}", "Serial": f"S{x}", "SwitchId": x, "Name": f"FI-{x}", "Dn": f"sys/switch-{x}", "ManagementIpAddress": f"10.0.0.{n}", "OutOfBandMac": f"00:11:22:33:44:0{n}", "RegisteredDevice": {"Moid": "dom-1"}}
    port = lambda x: {"Moid": f"port-{x}", "SlotId": 1, "PortId": 17, "SwitchId": x, "RegisteredDevice": {"Moid": "dom-1"}}
    ext = lambda x, n: {"Moid": f"ext-{x}", "SlotId": 1, "PortId": n, "MacAddress": f"74:E2:E7:FA:21:D{n}", "AcknowledgedPeerInterface": {"ObjectType": "ether.PhysicalPort", "Moid": f"port-{x}"}, "AdapterUnit": {"Moid": "adp"}}
    return {
        "fi": rows(spark, "fi", [side("A", 1), side("B", 2)]),
        "server": rows(spark, "server", [{"name": "s", "platform_id": "srv", "platform_metadata": {"device_moid": domain}}]),
        "adapter": rows(spark, "adapter", [{"Moid": "adp", "ComputeNode": {"Moid": "srv"}}]),
        "phy_port": rows(spark, "phy_port", [port("A"), port("B")] if cabled else []),
        "ext_eth": rows(spark, "ext_eth", [ext("A", 1), ext("B", 2)] if cabled else []),
    }


def test_cabled_ports_replace_plain_links(spark: SparkSession) -> None:
    found = {tuple(r)[1:5] for r in fabric.cables(**parts(spark, True), instance="t").collect()}
    assert found == {("intersight-fi:t:fi-A", "vic1/1", "Ethernet1/17", "74:E2:E7:FA:21:D1"), ("intersight-fi:t:fi-B", "vic1/2", "Ethernet1/17", "74:E2:E7:FA:21:D2")}
    assert fabric.cables(**parts(spark, True, "dom-1"), instance="t").count() == 2


def test_plain_links_need_a_common_domain(spark: SparkSession) -> None:
    assert fabric.cables(**parts(spark, False), instance="t").count() == 0
    found = {tuple(r)[:4] for r in fabric.cables(**parts(spark, False, "dom-1"), instance="t").collect()}
    assert found == {("intersight:t:srv", "intersight-fi:t:fi-A", "", ""), ("intersight:t:srv", "intersight-fi:t:fi-B", "", "")}


def test_identities(spark: SparkSession) -> None:
    row = fabric.identities(parts(spark, False)["fi"], "t").where("id like '%-A'").first()
    assert (row["mgmt_ip"], row["candidate_ips"], row["mac"]) == ("10.0.0.1", ["10.0.0.1"], "00:11:22:33:44:01")
    assert set(row["candidate_names"]) == {"FI-A", "A", "sys/switch-A"}


def test_tables_that_were_not_exported_are_empty(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "fi").mkdir()
    (tmp_path / "fi" / "a.json").write_text(json.dumps({"Moid": "m", "RegisteredDevice": {"Moid": "d"}}) + "\n")
    assert payloads.table(spark, str(tmp_path / "fi"), fabric.SCHEMAS["fi"]).first()["RegisteredDevice"]["Moid"] == "d"
    assert payloads.table(spark, str(tmp_path / "adapter"), fabric.SCHEMAS["adapter"]).count() == 0


def test_pushed_payloads(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"device": "d", "value": 1.5}\n{"device": "e"}\n')
    q = payloads.stream(spark, str(tmp_path / "in"), "device string, value double").writeStream.format("memory").queryName("pushed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["device"], r["value"]) for r in spark.table("pushed").collect()) == [("d", 1.5), ("e", None)]


def test_the_first_source_wins(spark: SparkSession) -> None:
    a = spark.createDataFrame([("10.0.0.0/24", "a"), ("10.0.1.1", "a"), (None, "a")], "cidr string, scope string")
    b = spark.createDataFrame([("10.0.0.0/24", "b"), ("10.0.1.1/32", "b"), ("10.9.0.0/16", "b")], "cidr string, scope string")
    assert {tuple(r) for r in payloads.prefixes(a, b).collect()} == {("10.0.0.0/24", "a"), ("10.0.1.1/32", "a"), ("10.9.0.0/16", "b")}


def test_clients_fall_back_to_networks(spark: SparkSession) -> None:
    schema = "id string, mac string"
    nets = spark.createDataFrame([("1", "m"), ("1", "m"), (None, "n"), (None, None)], schema)
    assert {tuple(r) for r in payloads.clients(spark.createDataFrame([], schema), nets).collect()} == {("1", "m"), (None, "n")}
    assert payloads.clients(spark.createDataFrame([("9", "z")], schema), nets).count() == 1


def test_management_addresses(spark: SparkSession) -> None:
    devices = spark.createDataFrame([("g", "n1", True, "10.1.0.1", "192.0.2.1"), ("h", "n2", True, "10.1.0.2", "192.0.2.2"), ("s", "n1", False, "10.1.0.3", "192.0.2.3")], "id string, network string, is_gateway boolean, vpn_ip string, wan_ip string")
    vlans = spark.createDataFrame([("n1", 20, "10.20.0.1"), ("n1", 5, "0.0.0.0"), ("n1", 10, "10.10.0.1")], "network string, vid int, appliance_ip string")
    found = {r["id"]: (r["mgmt_ip"], r["candidate_ips"]) for r in payloads.elected_address(devices, vlans).collect()}
    assert found == {"g": ("10.10.0.1", ["10.10.0.1", "10.1.0.1", "192.0.2.1"]), "h": ("10.1.0.2", ["10.1.0.2", "192.0.2.2"]), "s": ("192.0.2.3", ["192.0.2.3"])}


def test_small_fields(spark: SparkSession) -> None:
    df = spark.createDataFrame([(["127.0.0.1", "10.0.0.1"], "", " c ", "dc")], "ips array<string>, host string, cluster string, dc string")
    row = df.select(payloads.first_useful(F.col("ips")).alias("ip"), payloads.first_parent(F.col("host"), F.col("cluster"), F.col("dc")).alias("parent"), payloads.all_addresses(F.col("host"), F.col("dc"), nested=F.col("ips")).alias("every")).first()
    assert (row["ip"], row["parent"], row["every"]) == ("10.0.0.1", "c", ["dc", "127.0.0.1", "10.0.0.1"])
    summary = spark.createDataFrame([("1", "short", None), ("2", "only", "x")], "id string, name string, type string")
    detail = spark.createDataFrame([("1", "long", "fw")], "id string, name string, type string")
    assert {tuple(r) for r in payloads.detailed(summary, detail, "id").collect()} == {("1", "long", "fw"), ("2", "only", "x")}
