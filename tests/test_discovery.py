"""Exports of each kind of platform, with odd objects, as nodes and edges."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

from netloom.sources import discovery, inventory

EXPORTS: dict[str, dict[str, list]] = {
    "meraki/org": {
        "networks": [{"id": "N1", "name": "Main Campus", "productTypes": ["switch"]}, {"id": "N2"}, "not json", ["a list"]],
        "devices": [
            {"serial": "Q1", "name": "  core   switch ", "productType": "switch", "networkId": "N1", "lanIp": "10.0.0.2", "mac": "AA-BB-CC-00-00-01", "newField": {"x": 1}},
            {"serial": "Q2", "productType": "appliance", "networkId": "N1", "mac": "aabb.cc00.0002", "tags": ["edge", "hub"]},
            {"serial": "Q3", "productType": "appliance", "networkId": "N9", "firmware": None},
            {"serial": "Q1", "name": "a repeat"},
            {"name": "no serial"},
        ],
        "uplinks": [{"serial": "Q2", "uplinks": [{"interface": "wan1", "ip": "127.0.0.1"}, {"interface": "wan1", "ip": "192.0.2.7", "publicIp": "198.51.100.7"}]}, {"serial": "Q3", "uplinks": [{"interface": "wan2", "ip": "192.0.2.9"}]}, {"serial": "Q4", "uplinks": None}],
        "vlans": [{"networkId": "N1", "id": 20, "applianceIp": "10.20.0.1", "name": "Voice"}, {"networkId": "N1", "id": 5, "applianceIp": "10.5.0.1"}],
        "vpn": [{"deviceSerial": "Q2"}],
        "prefixes": [{"cidr": " 10.20.0.0/24 ", "scope": "vlan"}, {"cidr": "10.20.0.0/24", "name": "again"}, {"cidr": "10.0.0.1"}, {"cidr": None}],
        "topology": [{"ends": [{"device": {"serial": "Q1"}, "discovered": {"portId": "Gi1/0/1"}}, {"device": {"serial": "Q2"}}]}, {"ends": [{"device": {"serial": "Q1"}}]}, {"ends": [{"device": {"serial": "Q1"}}, {"device": {"serial": "Q8"}}]}],
        "lldp": [{"serial": "Q1", "ports": {"1": {"lldp": {"chassisId": "aa:bb:cc:00:00:02", "portId": "wan1"}}, "2": {"cdp": {"deviceId": "dist.example.net", "address": "10.9.9.9", "platform": "C9300", "portId": "Te1/1/1"}}, "3": {"lldp": {"chassisId": "aabbcc00ff01"}}, "4": {}}}],
        "clients": [{"mac": "AA:00:00:00:00:09", "ip": "10.20.0.9", "recentDeviceSerial": "Q1", "switchport": 7, "vlan": 20}, {"mac": "bad"}, {"mac": "AA:00:00:00:00:09", "ip": None, "ip6": "2001:db8::9"}],
    },
    "catalyst_center/dna": {
        "sites": [{"id": "s1", "name": "HQ East", "additionalInfo": [{"attributes": {"type": "building"}}]}, {"id": "s2", "name": "Lab", "additionalInfo": None}],
        "devices": [{"id": "d1", "hostname": "sw1", "family": "Switches and Hubs", "managementIpAddress": "10.1.1.1", "siteId": "s1", "reachabilityStatus": "Reachable"}, {"id": "d2", "managementIpAddress": "10.1.1.2", "siteId": "gone"}],
        "interfaces": [{"id": "i1", "deviceId": "d1", "portName": "Te1/1/1", "adminStatus": "UP", "macAddress": "aa:bb:cc:11:00:01", "ipv4Address": "10.1.2.1", "ipv4Mask": "255.255.255.0", "speed": "10000", "vrf": {"name": "x"}}, {"id": "i2", "deviceId": "d9"}],
        "vlans": [{"deviceId": "d1", "vlanNumber": 30, "interfaceName": "Vlan30"}, {"deviceId": "d1", "vlanNumber": 5000}, {"deviceId": "d1", "interfaceVlan": "x"}],
        "topology_nodes": [{"id": "d1"}, {"id": "t2", "ip": "10.1.1.2"}],
        "topology": [{"source": "d1", "target": "t2", "startPortName": "Gi1/0/2", "endPortName": "Gi0/1", "linkStatus": "up"}, {"source": "t2", "target": "d1"}, {"source": "d1", "target": "d1"}],
        "hosts": [{"hostMac": "00:11:22:33:44:55", "hostIp": " 10.1.3.3 ", "vlanId": 30}, {"hostMac": ""}],
    },
    "nexus_dashboard/dc": {
        "fabrics": [{"fabricName": "East DC", "bgpAsn": 65001}, {"name": ""}],
        "switches": [{"serialNumber": f"F{k}", "logicalName": f"leaf{k}", "fabricName": "East DC", "vtepIp": f"10.255.0.{k}"} for k in (1, 2, 3)] + [{"serialNumber": "F4", "fabricName": "West"}],
        "links": [{"fabricName": "East DC", "sw1-info": {"sw-serial-number": "F1", "if-name": "Eth1/1"}, "sw2-info": {"sw-serial-number": "F2", "if-name": "Eth1/2"}, "link-type": "ethisl"}, {"fabricName": "East DC", "sw1-info": {"sw-serial-number": "F2"}, "sw2-info": {"sw-serial-number": "F1"}}, {"sw1-info": None}],
        "vrfs": [{"fabricName": "East DC", "vrfName": "red", "vrfTemplateConfig": "{\"vrfSegmentId\": 50001, \"vrfRd\": \"1:1\"}"}, {"fabricName": "East DC", "vrfName": "blue", "vrfId": 7, "vrfTemplateConfig": {"vrfRd": "2:2"}}, {"vrfName": ""}],
        "networks": [{"fabricName": "East DC", "networkName": "web", "vlanId": "100", "networkId": 30100}, {"fabricName": "East DC", "vlanId": "none"}],
    },
    "fmc/fw": {
        "devices": [{"id": "u1", "name": "edge-fw", "type": "FTD", "hostName": "10.3.3.3", "healthStatus": "critical: unreachable", "metadata": {"domain": {"id": "dom-1"}}, "source": "dropped"}],
        "vlans": [{"vlanTag": 40, "name": "dmz"}],
        "interfaces": [{"deviceId": "u1", "name": "outside", "ipv4": {"static": {"address": "203.0.113.1"}}, "ipv6": {"addresses": [{"address": "2001:db8::1/64"}, "2001:db8::2"]}, "ipAddress": "203.0.113.1/24"}],
    },
    "thousandeyes/te": {
        "agents": [{"agentId": 1, "agentName": "va1", "agentType": "Enterprise", "ipAddresses": ["10.4.4.4", "127.0.0.1", "10.4.4.4"], "enabled": True, "agentState": "offline"}, {"id": "2", "agentType": "Enterprise Cluster", "clusterMembers": [{"memberId": 1}, 2, None]}, {"agentName": "no id"}],
        "endpoints": [{"id": "e1", "name": "laptop", "networkInterfaceProfiles": [{"interfaceName": "lo", "hardwareType": "loopback", "addressProfiles": [{"ipAddress": "10.0.0.99"}]}, {"interfaceName": "wifi0", "wirelessProfile": {"ssid": "corp", "rssi": -60}, "addressProfiles": [{"ipAddress": "10.4.5.5", "prefixLength": 24}, {"ipAddress": "169.254.1.1"}]}]}],
        "alerts": [{"a": 1}, {"a": 2}],
        "outages": [],
    },
    "netbox/main": {"sites": [{"id": 1, "slug": "hq", "name": "HQ", "status": {"value": "active"}, "latitude": 1.5}], "locations": [{"id": 10, "name": "Floor", "site": {"id": 1}}, {"id": 11, "name": "Room", "parent": {"id": 10}, "site": {"id": 1}}, {"id": 12, "name": "Lost", "parent": {"id": 99}}]},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory: pytest.TempPathFactory) -> str:
    root = tmp_path_factory.mktemp("exports")
    for place, kinds in EXPORTS.items():
        (root / place).mkdir(parents=True)
        for kind, rows in kinds.items():
            Path(root / place / f"{kind}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")
    return str(root)


@pytest.fixture(scope="module")
def graph(spark: SparkSession, folder: str) -> tuple[dict, set]:
    rows = discovery.discover(spark, folder).collect()
    nodes: dict = {}
    for r in rows:
        if r["kind"] == "node":
            nodes.setdefault(r["id"], r["props"] | {"_type": r["type"]})
    return nodes, {(r["src"], r["type"], r["dst"]) for r in rows if r["kind"] == "edge"}


def test_gateways_have_their_inner_address_on_the_tunnel_mesh_only(graph: tuple) -> None:
    nodes, _ = graph
    assert nodes["meraki:Q2"]["mgmt_ip"] == "10.5.0.1"
    assert json.loads(nodes["meraki:Q2"]["candidate_ips"]) == ["10.5.0.1", "10.20.0.1", "192.0.2.7", "198.51.100.7"]
    assert nodes["meraki:Q3"]["mgmt_ip"] == "192.0.2.9" and nodes["meraki:Q3"]["on_sdwan"] == "false"
    assert nodes["meraki:Q1"]["name"] == "core switch" and nodes["meraki:Q1"]["mgmt_ip"] == "10.0.0.2"
    assert nodes["meraki:Q2"]["tags"] == '["edge","hub"]' and nodes["meraki:Q2"]["role"] == "firewall"


def test_cloud_links_and_neighbours(graph: tuple) -> None:
    nodes, edges = graph
    assert ("meraki:Q1", "PHYSICAL_LINK", "meraki:Q2") in edges and ("meraki:Q1", "PHYSICAL_LINK", "lldp-neighbor:dist") in edges
    assert nodes["lldp-neighbor:dist"]["mgmt_ip"] == "10.9.9.9" and nodes["lldp-neighbor:dist"]["stub"] == "true"
    assert ("meraki-if:Q1:3", "LEARNED_MAC", "mac:aa:bb:cc:00:ff:01") in edges
    assert ("meraki-if:Q1:7", "LEARNED_MAC", "mac:aa:00:00:00:00:09") in edges and ("mac:aa:00:00:00:00:09", "HAS_ARP", "arp:2001:db8::9") in edges
    assert ("meraki:Q1", "LOCATED_AT", "meraki-network:N1") in edges and not any(s == "meraki:Q3" and t == "LOCATED_AT" for s, t, _ in edges)
    assert [k for k in nodes if k.startswith("prefix:")] == ["prefix:10.20.0.0/24"] and nodes["prefix:10.20.0.0/24"]["kind"] == "vlan_subnet"


def test_campus(graph: tuple) -> None:
    nodes, edges = graph
    assert nodes["catc-site:s1"]["site_type"] == "building" and nodes["catc:d1"]["role"] == "switch"
    assert ("catc:d2", "LOCATED_AT", "catc-site:unassigned:dna") in edges and "catc-site:unassigned:dna" in nodes
    assert [e for e in edges if e[1] == "PHYSICAL_LINK" and e[0].startswith("catc:")] == [("catc:d1", "PHYSICAL_LINK", "catc:d2")]
    assert nodes["catc-if:d1:i1"]["vrf"] == '{"name":"x"}' and nodes["catc-if:d1:i1"]["name"] == "Te1/1/1" and "catc-if:d9:i2" not in nodes
    assert [k for k in nodes if k.startswith("vlan:catc")] == ["vlan:catc:d1:30"] and nodes["arp:10.1.3.3"]["mac"] == "00:11:22:33:44:55"


def test_fabric(graph: tuple) -> None:
    nodes, edges = graph
    assert {e for e in edges if e[1] == "FABRIC_PEER"} == {(f"ndfc:dc:F{a}", "FABRIC_PEER", f"ndfc:dc:F{b}") for a, b in ((1, 2), (1, 3), (2, 3))}
    assert len([e for e in edges if e[1] == "PHYSICAL_LINK" and e[0].startswith("ndfc")]) == 1
    assert (nodes["ndfc-vrf:dc:East DC:red"]["vni"], nodes["ndfc-vrf:dc:East DC:blue"]["vni"], nodes["ndfc-vrf:dc:East DC:blue"]["rd"]) == ("50001", "7", "2:2")
    assert ("ndfc-vni:dc:30100", "VNI_EXTENDS", "ndfc-vlan:dc:East DC:100") in edges and ("ndfc:dc:F1", "LOGICAL_MEMBER", "ndfc-vlan:dc:East DC:100") in edges
    assert not any(s == "ndfc:dc:F4" and t == "LOCATED_AT" for s, t, _ in edges)


def test_firewalls_and_probes(graph: tuple) -> None:
    nodes, edges = graph
    assert nodes["fmc:fw:u1"]["status"] == "down" and "source" not in nodes["fmc:fw:u1"] and nodes["fmc:fw:u1"]["metadata"] == '{"domain":{"id":"dom-1"}}'
    assert {d for s, t, d in edges if t == "ASSIGNED_IP" and s.startswith("fmc-if")} == {"ip:203.0.113.1", "ip:2001:db8::1", "ip:2001:db8::2"}
    assert nodes["te-agent-enterprise:te:1"]["status"] == "down" and nodes["te-agent-enterprise:te:1"]["mgmt_ip"] == "10.4.4.4"
    assert ("te-agent-enterprise:te:1", "LOCATED_AT", "te-agent-enterprise-cluster:te:2") in edges
    assert nodes["te-account:te:default"]["alerts_active"] == "2" and "internet_outages_recent" not in nodes["te-account:te:default"]
    assert nodes["te-endpoint:te:e1"]["mgmt_ip"] == "10.4.5.5" and nodes["te-if:te:e1:wifi0"]["rssi"] == "-60"
    assert {d for s, t, d in edges if t == "ASSIGNED_IP" and s == "te-if:te:e1:wifi0"} == {"ip:10.4.5.5"}


def test_locations_lie_in_their_parent_else_their_site(graph: tuple) -> None:
    _, edges = graph
    assert {e for e in edges if e[1] == "WITHIN_LOCATION"} == {("nb-loc:10", "WITHIN_LOCATION", "nb-site:hq"), ("nb-loc:11", "WITHIN_LOCATION", "nb-loc:10")}


def test_places_are_pushed_down(spark: SparkSession, folder: str) -> None:
    only = inventory.objects(spark, folder, ["netbox"], ["sites", "nothing"]).where("line >= 0")
    assert only.count() == 1 and only.rdd.getNumPartitions() == 1
    assert inventory.objects(spark, folder).rdd.getNumPartitions() == sum(map(len, EXPORTS.values()))
    assert inventory.objects(spark, folder, ["none"]).count() == 0


def test_a_plain_load_may_serve_several_conditions(spark: SparkSession, folder: str) -> None:
    inventory.register(spark)
    rows = spark.read.format("inventory").load(folder)
    each = [len(x) for x in EXPORTS["netbox/main"].values()] + [len(x) for x in EXPORTS["fmc/fw"].values()]
    assert rows.where("adapter = 'netbox'").union(rows.where("adapter = 'fmc'")).count() == sum(each)


def test_an_empty_folder_gives_no_rows(spark: SparkSession, tmp_path: Path) -> None:
    frame: DataFrame = discovery.discover(spark, str(tmp_path))
    assert frame.count() == 0
