"""Edges, bounded cycles and chains, degrees and views of the transfer graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.adapter import micros
from tracewell.scratch import written


def communication_edges(events: DataFrame) -> DataFrame:
    c = events.where("event_type = 'CALL' AND entity_id IS NOT NULL AND counterparty_entity_id IS NOT NULL")
    return c.groupBy(F.col("entity_id").alias("src"), F.col("counterparty_entity_id").alias("dst")).agg(F.count("*").alias("calls"))


def money_edges(transfers: DataFrame) -> DataFrame:
    return transfers.groupBy(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst")).agg(F.round(F.sum(F.coalesce("amount", F.lit(0.0))), 2).alias("total"), F.count("*").alias("transfers"))


def digraph(transfers: DataFrame) -> DataFrame:
    """One edge (src, dst, amount, t) per ordered pair of different entities: that of its last transfer by ref."""
    last = F.max_by(F.struct("amount", "ts"), "ref")
    g = transfers.where("from_entity <> to_entity").groupBy(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst")).agg(last.alias("x"))
    return g.select("src", "dst", F.col("x.amount").alias("amount"), micros(F.col("x.ts")).alias("t"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, degree) over distinct directed edges."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(path): each simple cycle of two to `longest` nodes once, from its smallest node, by joins one edge at a time;
    the paths of each length are written."""
    e = written(edges.select("src", "dst").distinct(), "edges")
    found, paths = [], e.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    for n in range(2, longest + 1):
        back = e.select(F.col("src").alias("end"), F.col("dst").alias("_first"))
        found.append(paths.join(back, "end").where("_first = path[0]").select("path"))
        if n < longest:
            step = e.select(F.col("src").alias("end"), F.col("dst").alias("_next"))
            paths = paths.join(step, "end").where("_next > path[0] AND NOT array_contains(path, _next)").select(F.concat("path", F.array("_next")).alias("path"), F.col("_next").alias("end"))
            paths = written(paths, "paths")
    return reduce(DataFrame.unionByName, found)


def circular_flow(edges: DataFrame, longest: int = 6) -> DataFrame:
    """(entity_id, cycles, shortest) of the entities on any cycle."""
    c = cycles(edges, longest)
    return c.select(F.explode("path").alias("entity_id"), F.size("path").alias("n")).groupBy("entity_id").agg(F.count("*").alias("cycles"), F.min("n").alias("shortest"))


#: Edges kept of each node for chains: what remains after the chain's two other nodes are ruled out is still the best.
KEPT = 3


def _nearest(edges: DataFrame, node: str, other: str, best: Column) -> DataFrame:
    """For each node the KEPT edges of greatest `best`, its other ends all different."""
    rank = F.row_number().over(Window.partitionBy(node).orderBy(F.desc(best), other))
    return edges.withColumn("_n", rank).where(F.col("_n") <= KEPT).drop("_n")


def layering(edges: DataFrame, span_hours: int = 48) -> DataFrame:
    """(entity_id) on a chain of three edges over four different nodes, no edge later than the span after the first; an
    edge without a time is never too late.

    Chains are not listed. Of the edges into a node only the latest few can matter to what lies behind it, of those out of
    a node the earliest few, so joins stay linear in the edges, whatever the degree of a hub. edges: one for each ordered
    pair of different nodes.
    """
    span, far = span_hours * 3_600_000_000, 1 << 61
    e = edges.where("src <> dst").select("src", "dst", F.coalesce(F.col("t").cast("long"), F.lit(far)).alias("first"), F.coalesce(F.col("t").cast("long"), F.lit(-far)).alias("late"))
    e = written(e, "dated")
    into = _nearest(e.select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.col("first").alias("t1")), "n2", "n1", F.col("t1"))
    out = _nearest(e.select(F.col("src").alias("n3"), F.col("dst").alias("n4"), F.col("late").alias("t3")), "n3", "n4", -F.col("t3"))
    into, out = written(into, "into"), written(out, "out")
    mid = e.select(F.col("src").alias("n2"), F.col("dst").alias("n3"), F.col("late").alias("t2"))
    # The nodes in the middle: of at most KEPT edges on either side some pair fits, or none of all does.
    both = mid.join(into, "n2").where(f"n1 <> n3 AND t2 - t1 <= {span}").join(out, "n3").where(f"n4 <> n1 AND n4 <> n2 AND t3 - t1 <= {span}")
    inner = both.select(F.explode(F.array("n2", "n3")).alias("entity_id"))
    # The first node: after its edge to n2, the two edges from there that are over earliest, whichever node it is.
    ahead = mid.join(out, "n3").where("n4 <> n2").select("n2", F.col("n3").alias("a"), F.col("n4").alias("b"), (-F.greatest("t2", "t3")).alias("good"))
    behind = mid.join(into, "n2").where(f"n1 <> n3 AND t2 - t1 <= {span}").select("n3", F.col("n1").alias("a"), F.col("n2").alias("b"), F.col("t1").alias("good"))
    begin = _fitting(e.select(F.col("src").alias("x"), F.col("dst").alias("n2"), F.col("first").alias("t")), _spare(ahead, "n2"), "n2").where(f"-good - t <= {span}")
    end = _fitting(e.select(F.col("dst").alias("x"), F.col("src").alias("n3"), F.col("late").alias("t")), _spare(behind, "n3"), "n3").where(f"t - good <= {span}")
    return inner.unionByName(begin.select(F.col("x").alias("entity_id"))).unionByName(end.select(F.col("x").alias("entity_id"))).distinct()


def _spare(ways: DataFrame, node: str) -> DataFrame:
    """(node, a, b, good): for each node its best way over a and b, and the best ways that avoid the first one's a, and its
    b: one of the three is the best for whoever may not be on it."""
    rank = F.row_number().over(Window.partitionBy(node).orderBy(F.desc("good"), "a", "b"))
    w = written(ways, "ways")
    top = w.withColumn("_n", rank).where("_n = 1").drop("_n")
    one = top.select(node, F.col("a").alias("_a"), F.col("b").alias("_b"))
    met = w.join(one, node)
    spare = [met.where(f"a <> {x} AND b <> {x}").withColumn("_n", rank).where("_n = 1").select(node, "a", "b", "good") for x in ("_a", "_b")]
    return top.select(node, "a", "b", "good").unionByName(spare[0]).unionByName(spare[1])


def _fitting(ends: DataFrame, ways: DataFrame, node: str) -> DataFrame:
    """Ends of chains at each node with the ways from it that don't pass them."""
    return ends.join(ways, node).where("a <> x AND b <> x")


# ---------------------------------------------------------------- what a viewer asks for


def payload(money: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole graph: edges (src, dst, kind, amount, count), nodes (node, degree, external), where
    external are those that no edge leaves: others' records name them, none is their own."""
    edges = money.select("src", "dst", F.lit("MONEY").alias("kind"), F.col("total").alias("amount"), F.col("transfers").alias("count"))
    edges = edges.unionByName(calls.select("src", "dst", F.lit("COMMUNICATION").alias("kind"), F.lit(None).cast("double").alias("amount"), F.col("calls").alias("count")))
    d = degrees(edges)
    return d.select("node", "degree", (F.col("out_degree") == 0).alias("external")), edges


#: Nodes of a view (the reference's own limit).
VIEW = 200


def top_view(edges: DataFrame, most: int = VIEW) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the `most` nodes of highest degree, smaller ones first among equals, and the edges between them, by
    two semi joins."""
    nodes = degrees(edges).orderBy(F.desc("degree"), "node").limit(most)
    return nodes, induced(edges, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are among nodes."""
    own = nodes.select("node")
    return edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")


def ego(edges: DataFrame, focus: DataFrame, steps: int = 1) -> DataFrame:
    """(node, steps): the nodes within so many edges of any of focus (node), in either direction, and how many it takes."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    both = written(both, "both")
    seen = written(focus.select("node").distinct().withColumn("steps", F.lit(0)), "seen")
    for k in range(steps):
        edge = seen.where(F.col("steps") == k).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        seen = written(seen.unionByName(edge.join(seen, "node", "left_anti").withColumn("steps", F.lit(k + 1))), "seen")
    return seen
