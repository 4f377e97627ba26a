"""Betweenness by rounds of joins keyed by (source, node): no task and no driver ever holds the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.scratch import discard, written

#: Nodes up to which every node is a source; beyond it, so many of them are (the reference's own rule).
EXACT, PIVOTS = 800, 200


def _distances(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, d): the shortest distance from every source to every node it reaches. Each round goes one edge on from where
    a distance has become shorter; it ends when none has."""
    state = written(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0.0).alias("d"), F.lit(None).cast("double").alias("old")), "near")
    while True:
        moved = state.where("old IS NULL OR d < old")
        if moved.isEmpty():
            return state.select("s", "v", "d")
        on = moved.join(e, F.col("v") == F.col("src")).select("s", F.col("dst").alias("v"), (F.col("d") + F.col("distance")).alias("d"), F.lit(None).cast("double").alias("old"))
        both = state.select("s", "v", "d", F.col("d").alias("old")).unionByName(on)
        new = written(both.groupBy("s", "v").agg(F.min("d").alias("d"), F.min("old").alias("old")), "near")
        discard(state)
        state = new


def _ways(tight: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, v, level, ways): over the edges of shortest paths, the longest way to each node in edges, and how many there are.
    Each round counts one edge further; it ends when nothing changes."""
    first = sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("ways"))
    state, before = written(first, "ways"), None
    while True:
        now = state.agg(F.count("*"), F.sum("level"), F.sum("ways")).first()
        if now == before:
            return state
        before = now
        on = tight.join(state.withColumnRenamed("v", "u"), ["s", "u"]).groupBy("s", "v").agg((F.max("level") + 1).alias("level"), F.sum("ways").alias("ways"))
        new = written(on.unionByName(first), "ways")
        discard(state)
        state = new


def betweenness(edges: DataFrame, exact: int = EXACT, pivots: int = PIVOTS, seed: int = 42) -> DataFrame:
    """(node, betweenness): the share of shortest paths through each node over src, dst and distance, as in a directed
    graph. Repeated edges are summed; a distance of null or 0 counts as 1, self-loops count for nothing.

    Every node is a source in graphs of up to `exact` nodes; in larger ones `pivots` of them are, chosen by a hash, and
    scaled up. States are a row per source and node; the graph may have any size.
    """
    e = edges.groupBy("src", "dst").agg(F.sum("distance").alias("distance"))
    e = written(e.withColumn("distance", F.when(F.coalesce("distance", F.lit(0.0)) == 0, 1.0).otherwise(F.col("distance").cast("double"))), "edges")
    nodes = written(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), "nodes")
    n = nodes.count()
    few = n > exact and pivots < n
    sources = written(nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(pivots), "sources") if few else nodes
    e = e.where("src <> dst")
    near = _distances(e, sources)
    by_u = near.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    tight = by_u.join(e, F.col("u") == F.col("src")).join(near.select("s", F.col("v").alias("dst"), "d"), ["s", "dst"]).where("du + distance = d").select("s", "u", F.col("dst").alias("v"))
    tight = written(tight, "tight")
    ways = _ways(tight, sources)
    u = ways.select("s", F.col("v").alias("u"), F.col("level").alias("level_u"), F.col("ways").alias("ways_u"))
    steps = written(tight.join(u, ["s", "u"]).join(ways, ["s", "v"]).select("s", "u", "v", "level_u", "level", (F.col("ways_u") / F.col("ways")).alias("share")), "steps")
    deepest = ways.agg(F.max("level")).first()[0] or 0
    # From the farthest level back: a node's sum is whole when all levels behind it are done.
    parts: list[DataFrame] = []
    for level in range(deepest, 0, -1):
        own = steps.where(F.col("level") == level)
        if parts:
            behind = reduce(DataFrame.unionByName, parts).where(F.col("level") == level).groupBy("s", "v").agg(F.sum("part").alias("held"))
            own = own.join(behind, ["s", "v"], "left")
        else:
            own = own.withColumn("held", F.lit(None).cast("double"))
        part = F.sum(F.col("share") * (1 + F.coalesce("held", F.lit(0.0))))
        parts.append(written(own.groupBy("s", F.col("u").alias("v"), F.col("level_u").alias("level")).agg(part.alias("part")), "part"))
    scale = (n / pivots if few else 1.0) / max(1, (n - 1) * (n - 2))
    if not parts:
        return nodes.withColumn("betweenness", F.lit(0.0))
    total = reduce(DataFrame.unionByName, parts).where("v <> s").groupBy(F.col("v").alias("node")).agg((F.sum("part") * scale).alias("betweenness"))
    return nodes.join(total, "node", "left").fillna(0.0, ["betweenness"])
