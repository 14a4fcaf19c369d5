"""Reachability over undirected edges, a hop at a time.

A hop is one join of the frontier with the edges; lineage is cut after each, in
the session's shared checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.store import both_ways


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once in few bytes, as they are read several times."""
    place = f"{shared_folder(rows.sparkSession)}/stored-{uuid.uuid4().hex}"
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """``rows``, once each, dealt and sorted by a column for joins that then move
    the other side only. A checkpoint of an adaptive plan forgets how its rows
    are dealt, so this one is planned ahead."""
    spark, on = rows.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(on)
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by).distinct().sortWithinPartitions(by)
    spark.conf.set(on, "false")
    try:
        return _cut(rows)
    finally:
        spark.conf.set(on, before)


def _steps(edges: DataFrame) -> DataFrame:
    """Each edge once from either end, dealt by ``src`` for the joins of all hops."""
    return _dealt(both_ways(edges), "src")


def distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, distance, parent) of the nodes within ``hops`` of each of
    ``sources(node)`` over ``edges(src, dst)``; of parents at one distance the least."""
    steps = _steps(edges)
    seen = _cut(sources.select(F.col("node").alias("source"), "node").distinct().select("source", "node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    frontier = seen
    for d in range(1, hops + 1):
        near = frontier.join(steps, frontier["node"] == steps["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = _cut(near.join(seen, ["source", "node"], "left_anti").select("source", "node", F.lit(d).alias("distance"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def nearest(edges: DataFrame, gates: DataFrame, hops: int) -> DataFrame:
    """(node, site, gate, distance): of each site the nearest of ``gates(node,
    site)`` to each node within ``hops``, of equals the least. The search goes
    out from all gates at once and keeps one gate for a node and site, so it
    grows with nodes and sites, not with pairs of devices and gates."""
    steps = _steps(edges)
    seen = frontier = _cut(gates.groupBy("node", "site").agg(F.min("node").alias("gate")).withColumn("distance", F.lit(0)))
    for d in range(1, hops + 1):
        near = frontier.join(steps, frontier["node"] == steps["src"]).groupBy(F.col("dst").alias("node"), "site").agg(F.min("gate").alias("gate"))
        known = seen.select(F.col("node").alias("_node"), F.col("site").alias("_site"))
        frontier = _cut(near.join(known, (F.col("node") == F.col("_node")) & F.col("site").eqNullSafe(F.col("_site")), "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 15) -> DataFrame:
    """(source, target, distance, path) of ``pairs(source, target)``, of paths of
    one length the one of the least parents; pairs farther apart are left out.

    Both ends of a pair are searched from, by turns, until their surroundings
    meet, so each reaches half of the way only; an end whose pairs have all met
    is not searched from any more.
    """
    steps = _steps(edges)
    pairs = _cut(pairs.select("source", "target").distinct())
    start = lambda c: _cut(pairs.select(F.col(c).alias("end"), F.col(c).alias("node")).distinct().select("end", "node", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent")))
    sides = {c: start(c) for c in ("source", "target")}
    fronts, reached = dict(sides), {"source": 0, "target": 0}
    met = pairs.where("source = target").select("source", "target", F.lit(0).alias("distance"), F.col("source").alias("node"), F.lit(0).alias("back"))
    waiting = _cut(pairs.where("source <> target"))
    for total in range(1, hops + 1):
        c = "source" if reached["source"] <= reached["target"] else "target"
        reached[c] += 1
        live = fronts[c].join(waiting.select(F.col(c).alias("end")).distinct(), "end", "left_semi")
        near = live.join(steps, live["node"] == steps["src"]).groupBy("end", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        fronts[c] = _cut(near.join(sides[c], ["end", "node"], "left_anti").select("end", "node", F.lit(reached[c]).alias("distance"), "parent"))
        if fronts[c].isEmpty():
            break
        sides[c] = sides[c].union(fronts[c])
        # nearer meetings were seen before, so the outermost nodes of both sides meet
        there, here = (fronts[k].select(F.col("end").alias(k), "node") for k in ("source", "target"))
        hits = _cut(waiting.join(there, "source").join(here, ["target", "node"]).select("source", "target", F.lit(total).alias("distance"), "node", F.lit(reached["target"]).alias("back")))
        met = met.union(hits)
        waiting = _cut(waiting.join(hits, ["source", "target"], "left_anti"))
        if waiting.isEmpty():
            break
    met = _cut(met)
    most = met.agg(F.max("back"), F.max(F.col("distance") - F.col("back"))).first()
    # from where they met to the target: of each node on a shortest path the least one before it
    level, before = met.where(F.col("back") == most[0]), {}
    for k in range((most[0] or 0) - 1, -1, -1):
        outer = sides["target"].where(F.col("distance") == k).select(F.col("end").alias("target"), "node")
        near = level.join(steps, level["node"] == steps["src"]).select("source", "target", F.col("dst").alias("node"), F.col("src").alias("parent"))
        before[k] = _cut(near.join(outer, ["target", "node"]).groupBy("source", "target", "node").agg(F.min("parent").alias("parent")))
        level = before[k].select("source", "target", "node").union(met.where(F.col("back") == k).select("source", "target", "node"))
    walk = met.select("source", "target", "distance", F.array("target").alias("path"), F.col("target").alias("at")).distinct()
    for k in range(most[0] or 0):
        walk = walk.join(before[k].select("source", "target", F.col("node").alias("at"), "parent"), ["source", "target", "at"], "left")
        walk = walk.select("source", "target", "distance", F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.coalesce("parent", "at").alias("at"))
    back = sides["source"].select(F.col("end").alias("source"), F.col("node").alias("at"), "parent")
    for _ in range(most[1] or 0):
        walk = walk.join(back, ["source", "at"], "left")
        walk = walk.select("source", "target", "distance", F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.coalesce("parent", "at").alias("at"))
    return walk.select("source", "target", "distance", "path")


def neighborhood(nodes: DataFrame, edges: DataFrame, sources: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes within 1 to 4 ``hops`` of the sources, and the edges that paths of
    that length use: those with an end at a smaller distance."""
    hops = max(1, min(4, hops))
    near = _cut(distances(edges, sources, hops).groupBy("node").agg(F.min("distance").alias("distance")))
    inner = near.where(F.col("distance") < hops)
    used = [edges.join(inner.select(F.col("node").alias(end)), end, "left_semi").select(*edges.columns) for end in ("src", "dst")]
    return nodes.join(near, nodes["id"] == near["node"]).drop("node"), used[0].union(used[1]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges(src, dst)`` reaches.

    Labels spread along edges and jump to their label's label, until none changes.
    """
    steps = _steps(edges)
    labels = _cut(steps.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    while True:
        near = steps.join(labels, steps["dst"] == labels["node"]).groupBy(steps["src"].alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        following = _cut(labels.join(near, "node").join(jump, "component").select("node", F.least("component", "near", "up").alias("component")))
        moved = following.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = following
        if moved:
            return labels
