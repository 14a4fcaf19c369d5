"""What the findings of round 3 showed."""

from __future__ import annotations

import os
import random
import uuid
from ipaddress import ip_address
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netloom.llm import substring_chains
from netloom.operators import context, decorate, housekeeping, links, meetings, paths, store, upstream
from netloom.plans import graph, search_queries, stream_queries
from netloom.streaming import ingest
from tests.compare import FOLDER


def test_the_only_gate_of_tier_1_uses_one_of_tier_2(spark: SparkSession) -> None:
    """a is the only gate of tier 1 around; it doesn't bar itself from x."""
    links = spark.createDataFrame([("a", "m"), ("m", "x"), ("m", "c")], "src string, dst string")
    gates = spark.createDataFrame([("a", "s1", "A", 1), ("x", "s2", "X", 2)], "id string, site string, name string, tier int")
    edge = spark.createDataFrame([("a", "s1"), ("c", "s2")], "id string, site string")
    got = {r["device"]: (r["upstream"], r["tier"], r["hops"]) for r in upstream.ways_out(edge, gates, links).collect()}
    assert got == {"a": ("x", 2, 2), "c": ("a", 1, 2)}


def test_a_peer_looks_up_few_interfaces(spark: SparkSession) -> None:
    """many peers and interfaces in one /64 and one /24 don't meet each other."""
    six = lambda n: f"2001:db8::{n >> 16:x}:{n & 0xFFFF:x}"
    ifs = [(k, six(k * 40503 % 2**20), k % 7) for k in range(600)] + [(1000 + k, f"10.0.0.{k}", None) for k in range(0, 250, 9)]
    peers = [(k, six(k * 30011 % 2**20)) for k in range(900)] + [(1000 + k, f"10.0.0.{k}") for k in range(256)] + [(2000, "fe80::1"), (2001, "none")]
    number = lambda ip: int(ip_address(ip))
    want = {}
    for p, at in peers[:-1]:
        met = [(min(31 if "." in at else 127, (32 if "." in at else 128) - (number(at) ^ number(i)).bit_length()), h is not None, h or 0, -k, k) for k, i, h in ifs if ("." in i) == ("." in at)]
        best = max(met)
        if best[0] >= (24 if "." in at else 64):
            want[p] = (best[4], best[0])
    i = spark.createDataFrame(ifs, "iface long, ip string, health int")
    found = decorate.egress(spark.createDataFrame(peers, "peer long, peer_ip string"), i, [F.col("health"), -F.col("iface")])
    assert {r["peer"]: (r["iface"], r["prefix_len"]) for r in found.collect()} == want
    assert "_len" in found._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and all("_net" in x for x in joins)


def test_paths_to_dead_ends_are_not_held(spark: SparkSession) -> None:
    """of a star of 100 leaves only the path that can go on counts for the bound; all are returned."""
    edges = spark.createDataFrame([(k, f"leaf{k}", "hub") for k in range(100)] + [(100, "hub", "far")] + [(200 + k, "far", f"end{k}") for k in range(60)], "eid long, src string, dst string")
    got = context.unique_paths(edges, spark.createDataFrame([("leaf0",), ("leaf1",)], "node string"), 3, most=50)
    assert {tuple(r) for r in got.groupBy("source", "hops").count().collect()} == {(f"leaf{k}", n, m) for k in (0, 1) for n, m in ((1, 1), (2, 100), (3, 60))}


def test_edges_are_dealt_once_for_all_hops(spark: SparkSession) -> None:
    """a hop's join shuffles the frontier, not the edges."""
    steps = paths._steps(spark.createDataFrame([(f"n{k}", f"n{k % 7}") for k in range(50)], "src string, dst string"))
    front = spark.createDataFrame([("n3",), ("n9",)], "node string").hint("merge")
    plan = front.join(steps, front["node"] == steps["src"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_arrivals_of_several_files_a_step_lose_no_row(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """rows are made once, and a step may be several files; batches still are whole steps."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    base = f"{paths.shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "long").asNondeterministic()
    rows = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") * 600_000).alias("at")).withColumn("value", seen("event_id"))
    stream = stream_queries.arrivals(spark, base, rows)
    assert made.value == 4000
    sizes = []
    q = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda d, _: sizes.append(d.count())).start()
    q.awaitTermination()
    files = [f for f in os.listdir(f"{base}/arrivals".removeprefix("file:")) if f.endswith(".parquet")]
    assert sum(sizes) == 4001 and len(sizes) == 7 and sizes[-1] == 1 and len(files) > 7


def test_pairs_of_met_devices_are_not_shuffled(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """devices meet owners in cells, of which nothing is shuffled any more; also where both sides learn and own."""
    monkeypatch.setattr(meetings, "OWNED_ROWS", 40)
    monkeypatch.setattr(meetings, "BATCH_ROWS", 7)
    learned = [(f"d{k % 23}", f"Gi{k % 5}" if k % 11 else None, k % 9, k * 7 % 31) for k in range(160)]
    owned = [(f"{'ds'[k % 2]}{k % 29}", k * 5 % 12) for k in range(140)] + [("d1", 3), ("d1", 3), (None, 3), ("d2", None)]
    known = [(f"d{k}", f"d{k * 3 % 23}", "lldp") for k in range(0, 23, 4)] + [("s5", "d3", "cdp"), ("d4", "s7", "x")]
    shut = {tuple(sorted(p[:2])) for p in known if p[2] != "x"}
    first = lambda x: tuple((v is not None, v) for v in x)
    want = {}
    for d, i, ip, m in learned:
        for o, at in owned:
            pair = tuple(sorted((d, o or d)))
            if o not in (None, d) and at == ip and pair not in shut:
                want[pair] = min((i, m, d), want.get(pair, (i, m, d)), key=first)
    bound, own, links_ = spark.createDataFrame(learned, "device string, interface string, ip long, mac long"), spark.createDataFrame(owned, "device string, ip long"), spark.createDataFrame(known, "src string, dst string, proto string")
    found = links.from_arp(bound, own, links_)
    got = found.collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]): (r["interface_a"] if (a := want[r["src"], r["dst"]][2]) == r["src"] else r["interface_b"], r["mac"], a) for r in got} == want
    apart = links.from_macs(bound.select(F.concat(F.lit("x"), "device").alias("device"), "interface", "mac"), own.select("device", F.col("ip").alias("mac")), links_)
    plan = apart._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_swept_nodes_makes_lines_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """F8: rounds of the sweep read what is stored and lose each edge once."""
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "long").asNondeterministic()
    rows = graph.lines(spark, FOLDER)
    monkeypatch.setattr(search_queries, "lines", lambda *_: rows.withColumn("l_partkey", seen("l_partkey")))
    assert search_queries.swept_nodes(spark, FOLDER).count() > 0
    assert made.value == rows.count()


def test_sweep_equals_a_plain_one(spark: SparkSession) -> None:
    """F8: chains, shared and circular holders, repeated edges, and holders that aren't there."""
    nodes = [("d0", "Device"), ("d1", "Device")] + [(f"{n}{k}", t) for n, t in (("I", "Interface"), ("A", "IPAddress"), ("P", "Prefix")) for k in range(30)]
    edges = [(f"d{k % 4}", f"I{k}", "HAS_INTERFACE") for k in range(24)] + [(f"I{k}", f"A{(k * 7 + 3) % 30}", t) for k in range(30) for t in ("ASSIGNED_IP", "OTHER")]
    edges += [(f"P{k}", f"P{k + 1}", "HAS_PREFIX") for k in range(12)] * 2 + [("P20", "P21", "HAS_PREFIX"), ("P21", "P20", "ROUTES_TO"), ("d1", "P14", "ROUTES_TO"), ("P14", "P15", "ROUTES_TO"), ("P3", "P15", "HAS_PREFIX")]
    kind, there = dict(nodes), {n for n, _ in nodes}
    while True:
        left = {n for n in there if kind[n] not in housekeeping.NEEDS or any(d == n and s in there and t in housekeeping.NEEDS[kind[n]] for s, d, t in edges)}
        if left == there:
            break
        there = left
    kept, held = housekeeping.swept(spark.createDataFrame(nodes, "id string, type string"), spark.createDataFrame(edges, "src string, dst string, type string"))
    assert sorted(r["id"] for r in kept.collect()) == sorted(there) and 0 < len(there) < len(nodes)
    assert held.count() == sum(s in there and d in there for s, d, _ in edges)


def test_links_alone_with_their_pair_share_no_port(spark: SparkSession) -> None:
    """interface names are worked out for links beside others of their pair only; the rest isn't sorted again."""
    rows = [(k, f"a{k}", "b", "Gi0/1", "Eth1/1", "lldp", 0.5) for k in range(50)]
    rows += [(100, "x", "y", "Gi0/1", "Te0/1", "cdp", 0.5), (101, "y", "x", "Te0/1", "Gi0/2", "lldp", 0.5), (102, "x", "y", "GigabitEthernet0/2", "Te0/9", "cdp", 0.9), (103, "x", "y", "Gi0/7", None, "cdp", 0.1), (104, "x", "y", "Gi0/8", "", "arp_correlation", 0.1)]
    found = links.deduplicated(spark.createDataFrame(rows, "rid long, src string, dst string, interface_a string, interface_b string, proto string, confidence double"))
    assert sorted(r["rid"] for r in found.collect()) == [*range(50), 101, 103]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Window [") == 1


def test_joins_on_ports_work_names_out_once(spark: SparkSession) -> None:
    """names are columns before the join, not expressions of its keys; a link without a port meets none."""
    rows = spark.createDataFrame([(1, "a", "b", " gi0/1", "Te1"), (2, "a", "b", None, "te 1"), (3, "a", "b", "", "x")], "rid long, src string, dst string, interface_a string, interface_b string")
    facts = spark.createDataFrame([("a", "GigabitEthernet0/1", "up", 3), ("a", "", "down", 9), ("b", "TenGigabitEthernet1", "UP", 5)], "device string, name string, oper_status string, health_score int").withColumns({c: F.lit(1) for c in ("util_in_pct", "util_out_pct", "error_rate")})
    found = links.with_health(rows, facts, 7)
    assert {r["rid"]: (r["health_score"], r["oper_status"], r["single_sided"]) for r in found.collect()} == {1: (5, "up", False), 2: (5, "up", True), 3: (None, None, None)}
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and not any("regexp" in x for x in joins)


def test_contexts_share_what_lies_around_hubs(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """with hubs, alone or several beside a device, documents are those of a plain search; their join gives them out at once."""
    kinds = ["Device", "Interface", "VLAN", "VRF"]
    nodes = [(f"n{k:02}", kinds[k % 4], {"name": f"name{k}"}, "x") for k in range(48)]
    edges = [(k, f"n{(k * 7) % 40:02}", f"n{(k * k + 3) % 37:02}", "X", {"w": str(k % 3)}) for k in range(70)] + [(100 + k, f"n{k:02}", "n02", "LOGICAL_MEMBER", None) for k in range(0, 40, 2)] + [(200, "n04", "n04", "X", None), (201, "n08", "gone", "X", None), (202, "n08", None, "X", None)]
    edges += edges[:5]
    made = spark.createDataFrame(nodes, "id string, type string, props map<string,string>, source_adapter string"), spark.createDataFrame(edges, "eid long, src string, dst string, type string, props map<string,string>")
    kind = {n[0]: n[1] for n in nodes}
    for hub, hops in ((3, 1), (3, 2), (4, 3), (1000, 2)):
        monkeypatch.setattr(context, "HUB", hub)
        monkeypatch.setattr(context, "SHARE", 2)
        found = context.contexts(*made, spark.createDataFrame([(f"name{k}",) for k in range(0, 48, 4)], "name string"), hops)
        got = {r["device"]: r for r in found.collect()}
        assert set(got) == {f"n{k:02}" for k in range(0, 48, 4)}
        for device, doc in got.items():
            inner, near = set(), {device}
            for _ in range(hops):
                inner = set(near)
                near |= {x for _, s, d, *_ in edges for x in (s, d) if s in inner or d in inner}
            near &= set(kind)
            assert [n["id"] for n in doc["nodes"]] == sorted(near) and doc["n_nodes"] == len(near)
            assert doc["neighbors"] == sorted(n for n in near if kind[n] == "Device" and n != device) and doc["vlans"] == sorted(n for n in near if kind[n] == "VLAN")
            assert [e["id"] for e in doc["edges"]] == sorted({"-".join(x for x in (s, t, d, str(e)) if x is not None) for e, s, d, t, _ in edges if s in inner or d in inner}) and doc["n_edges"] == len(doc["edges"])
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Project") and plan[1].startswith("+- Join LeftOuter")


def test_surroundings_of_seeds_are_read_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """op7's disk: texts around frequent seeds were read, held and exploded for each round, a row for each place of a run of words."""
    rng = random.Random(7)
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(60)), *["the"] * 40, *(f"w{rng.randrange(10**6)}" for _ in range(60))]) for _ in range(7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls, exploded = [], []
    plain = substring_chains._surroundings
    monkeypatch.setattr(substring_chains, "_surroundings", lambda *a: calls.append(1) or plain(*a))
    substring_chains.passages(docs).collect()
    assert len(calls) == 1
    shared = substring_chains.shared_seeds(docs)
    by, _ = substring_chains.surroundings(docs, shared, spark.createDataFrame([], "doc_id long, start long, end long"))
    assert by.count() == 7
    runs = np.array([5, 9, 5, 5, *range(100, 150), 9], np.uint32)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), pa.array([0, 1]), pa.array([runs.tobytes(), runs[:3].tobytes()])], ["seed", "print", "doc_id", "runs"])
    for b in substring_chains._distinct_runs(iter([batch])):
        exploded += [(r["print"], r["run"], [k for k in range(96) if (r["low"] | r["high"] << 48) >> k & 1]) for r in b.to_pylist()]
    assert exploded == [(3, 5, [0, 2, 3]), (3, 9, [1, 54]), *((3, k, [k - 96]) for k in range(100, 150)), (4, 5, [0, 2]), (4, 9, [1])]


def test_equal_rows_are_folded_without_sorts(spark: SparkSession) -> None:
    """F16: rows of one content come out as they are; others are still laid over each other in order."""
    schema = "type string, src string, dst string, interface_a string, interface_b string, props map<string,string>, source_adapter string"
    rows = [("R", "a", "b", None, None, {"x": "1", "n": None}, "p")] * 3 + [("R", "b", "a", None, "i", None, "p")] * 2 + [("P", "c", "d", "1", "2", {"x": "1", "y": "2"}, "p"), ("P", "c", "d", "1", "2", {"x": "3", "y": None}, "q"), ("P", "c", "d", "1", None, {}, "q")]
    folded = store._folded(spark.createDataFrame(rows, schema), store.EDGE_KEY)
    got = {tuple(r[k] for k in store.EDGE_KEY): (r["props"], r["source_adapter"]) for r in folded.collect()}
    assert folded.count() == 4
    assert got == {("R", "a", "b", None, None): ({"n": None, "x": "1"}, "p"), ("R", "b", "a", None, "i"): ({}, "p"), ("P", "c", "d", "1", "2"): ({"x": "3", "y": None}, "q"), ("P", "c", "d", "1", None): ({}, "q")}
    once = store._folded(spark.createDataFrame(rows[:5], schema), store.EDGE_KEY)
    once.collect()
    assert "SortAggregate" not in once._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_large_bucket_is_written_by_several_tasks(spark: SparkSession, tmp_path: Path) -> None:
    """each of the buckets was sorted and written by one task."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000, numPartitions=8).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("Device").alias("type"), F.create_map(F.lit("k"), F.sha2(F.col("id").cast("string"), 256)).alias("props"), F.lit("x").alias("source_adapter"))
        nodes, _ = ingest.graph_tables(spark, str(tmp_path), buckets=2)
        nodes.merge(rows, 0, lambda old: store.upsert_nodes(old, rows, 1))
        assert nodes.read().count() == 60_000
        assert min(len(list((tmp_path / f"nodes/data/n=0/bucket={b}").glob("*.parquet"))) for b in range(2)) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
