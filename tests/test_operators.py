from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators import context, decorate, housekeeping, links, paths, resolve, snmp, store, upstream, vlan_evidence


def test_parallel_cables_stay_apart(spark: SparkSession) -> None:
    rows = [
        (1, "a", "b", "Gi1", "Eth1/1", "lldp", 1.0),
        (2, "b", "a", "Ethernet1/1", "GigabitEthernet1", "cdp", 0.9),
        (3, "a", "b", "Gi2", "Eth1/2", "lldp", 1.0),
        (4, "a", "b", None, None, "mac_correlation", 0.85),
        (5, "c", "d", None, None, "mac_correlation", 0.85),
    ]
    df = spark.createDataFrame(rows, "rid long, src string, dst string, interface_a string, interface_b string, proto string, confidence double")
    assert {r["rid"] for r in links.deduplicated(df).collect()} == {1, 3, 5}
    assert links.deduplicated(df.limit(0)).count() == 0


def edges(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, {"k": "v"}, "x") for r in rows], "src string, dst string, type string, interface_a string, interface_b string, props map<string,string>, source_adapter string")


def test_upsert_is_idempotent(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "type string, src string, dst string, interface_a string, interface_b string, props map<string,string>, source_adapter string, first_seen bigint, last_seen bigint, hash string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    snap = edges(spark, [("b", "a", "PHYSICAL_LINK", "1", "2"), ("a", "b", "PHYSICAL_LINK", "2", "1"), ("a", "z", "ROUTES_TO", None, None)])
    first = store.upsert_edges(none, snap, nodes, 1)
    assert [(r["src"], r["dst"], r["interface_a"], r["change"]) for r in first.collect()] == [("a", "b", "2", "created")]
    again = store.upsert_edges(first.drop("change"), snap, nodes, 2).collect()
    assert [(r["change"], r["first_seen"], r["last_seen"]) for r in again] == [("touched", 1, 2)]


def test_null_removes_a_property(spark: SparkSession) -> None:
    schema = "id string, type string, props map<string,string>, source_adapter string"
    empty = spark.createDataFrame([], schema + ", first_seen bigint, last_seen bigint, hash string, status_changed_at bigint")
    one = store.upsert_nodes(empty, spark.createDataFrame([("n", "Device", {"a": "1", "b": "2"}, "x")], schema), 1).drop("change")
    two = store.upsert_nodes(one, spark.createDataFrame([("n", "Device", {"a": None, "c": "3"}, "x")], schema), 2).first()
    assert two["props"] == {"b": "2", "c": "3"} and two["change"] == "updated"


def test_stub_priority_and_absorption(spark: SparkSession) -> None:
    stubs = spark.createDataFrame([("s1", "AA:BB:CC:DD:EE:FF", "10.0.0.1", "core.x.net", None), ("s2", None, "10.0.0.9", "other", None), ("s3", None, None, "other.y", "lldp")], "id string, chassis_mac string, mgmt_ip string, name string, discovered_via string")
    mac = resolve.by_mac(stubs, spark.createDataFrame([("r1", "aa:bb:cc:dd:ee:ff")], "device string, mac string"))
    ip = resolve.by_ip(stubs, spark.createDataFrame([("10.0.0.1", "r9")], "ip string, device string"), spark.createDataFrame([("r2", ["10.0.0.9"])], "id string, candidate_ips array<string>"))
    name = resolve.by_name(stubs, spark.createDataFrame([("r7", "CORE")], "id string, name string"))
    assert {(r["stub"], r["canonical"]) for r in name.collect()} == {("s1", "r7"), ("s2", "s3")}
    assert {(r["stub"], r["canonical"]) for r in resolve.priority(mac, ip, name).collect()} == {("s1", "r1"), ("s2", "r2")}
    moved = resolve.absorb(edges(spark, [("s1", "r1", "PHYSICAL_LINK", "1", "2"), ("s1", "b", "PHYSICAL_LINK", "1", "2"), ("r1", "b", "PHYSICAL_LINK", "1", "2"), ("s1", "b", "ROUTES_TO", "", "")]), mac)
    assert {(r["src"], r["dst"], r["type"]) for r in moved.collect()} == {("r1", "b", "PHYSICAL_LINK"), ("s1", "b", "ROUTES_TO")}


def test_paths(spark: SparkSession) -> None:
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    found = paths.shortest_paths(e, spark.createDataFrame([("a", "d"), ("a", "x"), ("a", "a")], "source string, target string")).collect()
    assert {(r["source"], r["target"]): r["path"] for r in found} == {("a", "d"): ["a", "b", "c", "d"], ("a", "a"): ["a"]}
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    near, used = paths.neighborhood(nodes, e, spark.createDataFrame([("a",)], "node string"), 2)
    assert {r["id"] for r in near.collect()} == {"a", "b", "c"} and used.count() == 2


def test_walks(spark: SparkSession) -> None:
    lines = ['.1.3.6.1.2.1.2.2.1.2.7 = STRING: "Gi0/7"', ".1.3.6.1.2.1.2.2.1.8.7 = INTEGER: 1", ".1.3.6.1.2.1.31.1.1.1.15.7 = Gauge32: 1000", ".1.3 = No Such Object available on this agent at this OID", "# note", "", ".1.5 = Hex-STRING: AA BB"]
    walk = snmp.parse_lines(spark.createDataFrame([("d", x) for x in lines], "device string, line string"))
    assert {r["oid"]: r["value"] for r in walk.collect()}["1.5"] == "aabb" and walk.count() == 4
    assert [tuple(r) for r in snmp.interfaces(walk).collect()] == [("d", 7, "Gi0/7", 1000, None, "up")]
    text = "Protocol  Address\nInternet  10.1.1.1   5   aabb.ccdd.eeff  ARPA   Vlan10\nInternet  10.1.1.2   -   0011.2233.4455  ARPA"
    arp = snmp.arp_text(spark.createDataFrame([("d", text)], "device string, text string")).collect()
    assert [(r["ip"], r["mac"], r["interface"]) for r in arp] == [("10.1.1.1", "aa:bb:cc:dd:ee:ff", "Vlan10"), ("10.1.1.2", "00:11:22:33:44:55", None)]


def test_uplinks_and_peers(spark: SparkSession) -> None:
    up = spark.createDataFrame([("m", "down", "online", None), ("m", None, "online", "stale"), ("n", None, "offline", None)], "device string, uplink_status string, status string, snmp_health string")
    state = {r["device"]: (r["oper_state"], r["health_score"]) for r in decorate.gateway_state(decorate.uplink_health(up)).collect()}
    assert state == {"m": ("up", 80), "n": ("down", 80)}
    d = spark.createDataFrame([("r1", ["10.0.0.1"], "1.1.1.1", None), ("r2", None, "10.0.0.1", ["2.2.2.2"])], "id string, ips array<string>, mgmt_ip string, candidate_ips array<string>")
    p = spark.createDataFrame([("p", "10.0.0.1"), ("q", "2.2.2.2"), ("z", "9.9.9.9")], "peer string, peer_ip string")
    assert {r["peer"]: r["remote_device"] for r in decorate.match_peers(p, d).collect()} == {"p": "r1", "q": "r2", "z": None}


def test_prefixes_of_links(spark: SparkSession) -> None:
    ls = spark.createDataFrame([(1, "a", "b", "Gi1", "Gi2"), (2, "a", "c", "Gi3", "Gi4")], "rid long, src string, dst string, interface_a string, interface_b string")
    addr = spark.createDataFrame([("a", "10.0.0.0", 24), ("b", "10.0.0.0", 24), ("c", "10.9.0.0", 24)], "device string, network string, prefix_len int")
    routes = spark.createDataFrame([("c", "gi4", "192.168.0.0/24")], "device string, interface string, cidr string")
    assert {r["rid"]: r["prefixes"] for r in links.with_prefixes(ls, addr, routes).orderBy("rid").collect()} == {1: ["10.0.0.0/24"], 2: ["192.168.0.0/24"]}
    ports = spark.createDataFrame([("a", "GigabitEthernet1", "forwarding", "root", "m", 5)], "device string, interface string, state string, role string, root string, vlan int")
    assert links.with_stp(ls, ports).orderBy("rid").first()["stp_role_a"] == "root"
    assert links.with_penalty(spark.createDataFrame([(10, 90.0)], "health_score int, util_avg_1h double")).first()["health_score"] == 60


def test_chain_of_shared_ports(spark: SparkSession) -> None:
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e")], "src string, dst string")
    assert {(r["node"], r["component"]) for r in paths.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert paths.components(e.where(F.lit(False))).count() == 0


def test_sources_of_one_node_are_laid_over_each_other(spark: SparkSession) -> None:
    schema = "id string, type string, props map<string,string>, source_adapter string"
    empty = spark.createDataFrame([], schema + ", first_seen bigint, last_seen bigint, hash string, status_changed_at bigint")
    rows = [("n", "Device", {"a": "1", "b": "2"}, "m"), ("n", "Device", {"b": "3", "c": None}, "x"), ("n", "Device", {"c": "9", "d": "4"}, "m"), ("n", "Device", {"c": "9", "d": "4"}, "m"), ("p", "Device", None, "m")]
    got = {r["id"]: r for r in store.upsert_nodes(empty, spark.createDataFrame(rows, schema), 1).collect()}
    assert {k: v for k, v in got["n"]["props"].items() if v is not None} == {"a": "1", "b": "3", "d": "4"} and got["n"]["source_adapter"] == "x"
    assert got.keys() == {"n", "p"} and got["p"]["props"] == {}


def test_upstream_prefers_the_own_site(spark: SparkSession) -> None:
    steps = spark.createDataFrame([("e", "m"), ("m", "g1"), ("m", "x"), ("x", "g2"), ("f", "g1")], "src string, dst string")
    gates = spark.createDataFrame([("g1", 1), ("g2", 2)], "id string, site int")
    edge = spark.createDataFrame([("e", 2), ("f", 3), ("lost", 1)], "id string, site int")
    got = {tuple(r) for r in decorate.upstream(edge, gates, steps).collect()}
    assert got == {("e", "g2", 3), ("f", "g1", 1), ("lost", "internet:0", None)}
    assert {tuple(r) for r in decorate.upstream(edge, gates, steps, hops=2).collect()} == {("e", "g1", 2), ("f", "g1", 1), ("lost", "internet:0", None)}


def test_evidence_stays_in_scope(spark: SparkSession) -> None:
    vlans = spark.createDataFrame([("vlan:nb:a:5", 5, "a", None), ("vlan:ps:x:5", 5, None, ["ps:x", None])], "id string, vid int, slug string, sites array<string>")
    devices = spark.createDataFrame([("d1", "a"), ("d2", "b"), ("d3", None)], "id string, slug string")
    located = spark.createDataFrame([("d3", "ps:x"), ("d1", None)], "device string, site string")
    ports = spark.createDataFrame([("i1", "d1", "Vl5"), ("i2", "d2", "vlan5"), ("i3", "d3", "Vlan 5"), ("i4", "d1", "Vlan6"), ("i5", "d1", None)], "id string, device string, name string")
    addresses = spark.createDataFrame([("i1", "10.5.0.0/24"), ("i3", "")], "interface string, subnet string")
    prefixes = spark.createDataFrame([("p1", "10.5.0.0/24", None, None, None, None), ("p2", "10.6.0.0/24", 5, "x", None, None), ("p3", "10.7.0.0/24", None, None, 5, ""), ("p4", "10.8.0.0/24", 5, "y", 5, "b")], "id string, cidr string, vid int, network_id string, ipam_vid int, ipam_site string")
    routes = spark.createDataFrame([("d1", None, "p3"), ("d3", "vlan-5", "p4"), ("d2", "vlan5", "p1"), ("d1", "x", "p1")], "device string, interface string, prefix string")
    svis, edges, members = vlan_evidence.link(vlans, devices, located, ports, addresses, prefixes, routes)
    assert {tuple(r) for r in svis.collect()} == {("vlan:nb:a:5", "i1", "d1"), ("vlan:ps:x:5", "i3", "d3")}
    assert {(r["vlan"], r["prefix"]): [k for k in vlan_evidence.KINDS if r[f"via_{k}"]] for r in edges.collect()} == {("vlan:nb:a:5", "p1"): ["svi"], ("vlan:ps:x:5", "p2"): ["tag"], ("vlan:nb:a:5", "p3"): ["ipam"], ("vlan:ps:x:5", "p4"): ["routes_to"]}
    assert {tuple(r) for r in members.collect()} == {("vlan:nb:a:5", "d1"), ("vlan:ps:x:5", "d3")}
    wrong = spark.createDataFrame([("vlan:nb:a:5", "d1"), ("vlan:nb:a:5", "d2"), ("vlan:nb:a:5", "d3"), ("vlan:ps:x:5", "d2")], "vlan string, device string")
    assert {r["device"] for r in vlan_evidence.out_of_scope(wrong, vlans, devices).collect()} == {"d2", "d3"}


def test_two_sided_paths_equal_a_plain_search(spark: SparkSession) -> None:
    """Of paths of one length the one whose nodes, seen from the target, are the least."""
    rng = random.Random(8)
    for n, m in ((40, 55), (25, 24), (30, 120)):
        nodes = [f"n{k:02}" for k in range(n)]
        edges = [tuple(rng.sample(nodes, 2)) for _ in range(m)]
        steps: dict[str, set[str]] = {x: set() for x in nodes}
        for a, b in edges:
            steps[a].add(b)
            steps[b].add(a)
        pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(40)]
        want = {}
        for a, b in pairs:
            away, front = {a: 0}, [a]
            while front:
                front = sorted({y for x in front for y in steps[x]} - set(away))
                away |= dict.fromkeys(front, max(away.values()) + 1)
            if away.get(b, 99) <= 6:
                path = [b]
                while path[0] != a:
                    path.insert(0, min(x for x in steps[path[0]] if away.get(x, 99) == away[path[0]] - 1))
                want[a, b] = path
        got = paths.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "source string, target string"), 6).collect()
        assert {(r["source"], r["target"]): r["path"] for r in got} == want and len(got) == len(want)
        assert all(r["distance"] == len(r["path"]) - 1 for r in got)


def test_a_gate_takes_another_way_out(spark: SparkSession) -> None:
    """Gates a and b both serve c; each uses the other, through nodes whose nearest gate is the one that asks."""
    links = spark.createDataFrame([("a", "x"), ("x", "y"), ("y", "b"), ("y", "c"), ("d", "d2")], "src string, dst string")
    gates = spark.createDataFrame([("a", "s1", "A", 1), ("b", "s2", "B", 1), ("x", "s2", "X", 2)], "id string, site string, name string, tier int")
    edge = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s1"), ("x", None), ("d", "s1")], "id string, site string")
    got = {r["device"]: (r["upstream"], r["tier"], r["same_site"], r["hops"]) for r in upstream.ways_out(edge, gates, links).collect()}
    assert got == {"a": ("b", 1, False, 3), "b": ("a", 1, False, 3), "c": ("a", 1, True, 3), "x": ("a", 1, True, 1), "d": ("internet:0", None, None, None)}


def test_unique_paths_use_no_edge_twice(spark: SparkSession) -> None:
    edges = [(1, "a", "b"), (2, "a", "b"), (3, "b", "c"), (4, "c", "c"), (5, "c", "a")]
    want = []

    def walk(at: str, used: tuple, nodes: tuple) -> None:
        if used:
            want.append((used, nodes))
        if len(used) < 4:
            for e, x, y in edges:
                for a, b in {(x, y), (y, x)}:
                    if a == at and e not in used:
                        walk(b, (*used, e), (*nodes, b))

    walk("a", (), ("a",))
    got = context.unique_paths(spark.createDataFrame(edges, "eid long, src string, dst string"), spark.createDataFrame([("a",)], "node string"), 9).collect()
    assert sorted((tuple(r["edge_ids"]), tuple(r["nodes"])) for r in got) == sorted(want)
    with pytest.raises(ValueError, match="fewer"):
        context.unique_paths(spark.createDataFrame(edges, "eid long, src string, dst string"), spark.createDataFrame([("a",)], "node string"), 4, most=3)


def test_context_of_the_best_device_of_a_name(spark: SparkSession) -> None:
    nodes = spark.createDataFrame([("d1", "Device", {"name": "sw", "stub": "true"}, "a"), ("d2", "Device", {"name": "sw"}, "b"), ("d3", "Device", {"name": "sw", "id": "reserved"}, "a"), ("i1", "Interface", {"name": "Gi1"}, "b"), ("v1", "VLAN", None, None), ("far", "Device", {"name": "x"}, "a")], "id string, type string, props map<string,string>, source_adapter string")
    edges = spark.createDataFrame([(1, "d3", "i1", "HAS_INTERFACE", None), (2, "i1", "v1", "LOGICAL_MEMBER", {"k": "v"}), (3, "v1", "far", "X", None), (4, "d3", "d2", "PHYSICAL_LINK", None), (5, "d3", "d2", "PHYSICAL_LINK", None)], "eid long, src string, dst string, type string, props map<string,string>")
    (doc,) = context.contexts(nodes, edges, spark.createDataFrame([("sw",), ("none",)], "name string"), 2).collect()
    assert (doc["device"], doc["neighbors"], doc["interfaces"], doc["vlans"]) == ("d3", ["d2"], ["i1"], ["v1"])
    assert {e["id"] for e in doc["edges"]} == {"d3-HAS_INTERFACE-i1-1", "i1-LOGICAL_MEMBER-v1-2", "d3-PHYSICAL_LINK-d2-4", "d3-PHYSICAL_LINK-d2-5"}
    assert [n["id"] for n in doc["nodes"]] == ["d2", "d3", "i1", "v1"] and '"neo4j_id":"reserved"' in doc["nodes"][1]["props"]


def test_chains_of_unheld_nodes_go_in_one_call(spark: SparkSession) -> None:
    nodes = spark.createDataFrame([("d", "Device"), ("i", "Interface"), ("p", "IPAddress"), ("lost", "Interface"), ("q", "IPAddress"), ("both", "IPAddress"), ("m", "MACAddress"), ("r", "ARPEntry"), ("v", "VLAN")], "id string, type string")
    edges = spark.createDataFrame([("d", "i", "HAS_INTERFACE"), ("i", "p", "ASSIGNED_IP"), ("gone", "lost", "HAS_INTERFACE"), ("lost", "q", "ASSIGNED_IP"), ("lost", "both", "ASSIGNED_IP"), ("i", "both", "ASSIGNED_IP"), ("lost", "m", "LEARNED_MAC"), ("m", "r", "HAS_ARP"), ("i", "q", "OTHER"), ("i", "v", "LOGICAL_MEMBER")], "src string, dst string, type string")
    kept, left = housekeeping.swept(nodes, edges)
    assert {r["id"] for r in kept.collect()} == {"d", "i", "p", "both", "v"}
    assert {(r["src"], r["dst"]) for r in left.collect()} == {("d", "i"), ("i", "p"), ("i", "both"), ("i", "v")}
