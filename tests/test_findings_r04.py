"""What the findings of round 4 showed."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netloom.llm import substring_chains
from netloom.operators import context
from netloom.plans import graph, link_queries, stream_queries
from netloom.streaming import stateful
from tests.compare import FOLDER


def test_seeds_are_made_once(spark: SparkSession) -> None:
    """op7's seeds were made and shuffled twice, for their counts and for the join with these."""
    texts = [" ".join(f"w{(k % 3) * 7 + j % (40 + k)}" for j in range(90)) for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    shared = substring_chains.shared_seeds(docs.withColumn("text", seen("text")))
    got = {(r["seed"], r["doc_id"]): (r["head"], r["short"]) for r in shared.collect()}
    assert made.value == len(texts)
    owners: dict = {}
    for r in substring_chains.seeds(docs).collect():
        owners.setdefault(r["seed"], []).append(r["doc_id"])
    assert got == {(s, d): (min(o), len(o) <= substring_chains.SHORT) for s, o in owners.items() if len(o) > 1 for d in o} and {s for _, s in got.values()} == {True, False}


def test_keys_share_states(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    """each key had states and timers of its own; large, missing and equal numbers side by side stay what they are."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    rng = random.Random(3)
    rows = [(None if k % 50 == 0 else 2**60 + k % 40, 3_600_000 * rng.randrange(900), rng.choice(["up", "down", None]), k) for k in range(600)]
    seen, want = {}, []
    for e, at, s, k in sorted(rows, key=lambda r: (r[1], r[3])):
        before = seen.get(e)
        if before is None or before[1] != s or at - before[0] > stateful.WEEK:
            want.append((e, at, s))
        seen[e] = (at, s)
    made = spark.createDataFrame(rows, "element long, at long, state string, event_id long")
    out, q = stateful.collected(stateful.flaps(stream_queries.arrivals(spark, str(tmp_path), made), "2 days"), str(tmp_path))
    order = lambda rs: sorted(rs, key=str)
    assert order(map(tuple, out.collect())) == order(want)
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) < 40


def test_paths_are_dealt_to_few_pieces(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """paths to a node were shuffled again for each piece of its edges, as many as it has edges."""
    monkeypatch.setattr(context, "PIECE", 1)
    edges = spark.createDataFrame([(k, f"leaf{k}", "hub") for k in range(320)], "eid long, src string, dst string")
    found = context.unique_paths(edges, spark.createDataFrame([("leaf0",), ("leaf1",)], "node string"), 2)
    assert {tuple(r) for r in found.groupBy("hops").count().collect()} == {(1, 2), (2, 2 * 319)}
    fans: list[int] = []
    plain = context._cut
    monkeypatch.setattr(context, "_cut", lambda d: fans.append(d.select("piece").distinct().count()) or plain(d) if "piece" in d.columns else plain(d))
    context.unique_paths(edges, spark.createDataFrame([("leaf0",)], "node string"), 2)
    assert fans and 1 < fans[0] <= 8 * 4


def test_pairs_of_lines_are_made_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """the join of lines and orders was made for each use of its pairs."""
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "string").asNondeterministic()
    rows = graph.topology(spark, FOLDER)
    monkeypatch.setattr(link_queries, "topology", lambda *_: rows.withColumn("src", seen("src")))
    assert link_queries.wan_upstream_bfs(spark, FOLDER).count() > 0
    assert made.value == rows.count()
