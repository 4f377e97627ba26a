"""Communities of greatest modularity: groups are merged, single nodes moved, and the graph of groups taken up again.

All rounds are joins and aggregations over edges and groups. Modularity is the share of edges inside groups, less what it
would be by chance; no round that lowers it is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.scratch import written

#: Rounds of merging, of moving single nodes, and of both again.
MERGES, MOVES, AGAIN = 60, 25, 4
LEAST = 1e-12
#: Gain of modularity under which a further round of moves, or of both, isn't worth its joins.
WORTH = 1e-4


def modularities(links: DataFrame, m: float, *pairs: tuple[str, str]) -> list[float]:
    """links: w of each undirected edge once and, for each way to group it, the columns of its two groups, alike inside
    one. One job finds the modularity of every way."""
    ends = []
    for i, (a, b) in enumerate(pairs):
        own = F.when(F.col(a) == F.col(b), F.col("w")).otherwise(0.0)
        ends += [F.struct(F.lit(i).alias("way"), F.col(a).alias("c"), own.alias("inside")), F.struct(F.lit(i).alias("way"), F.col(b).alias("c"), F.lit(0.0).alias("inside"))]
    of = links.select(F.explode(F.array(*ends)).alias("x"), "w").groupBy("x.way", "x.c").agg(F.sum("w").alias("k"), F.sum("x.inside").alias("inside"))
    rows = of.groupBy("way").agg(F.sum("inside").alias("inside"), F.sum((F.col("k") / (2 * m)) ** 2).alias("chance")).collect()  # one row per way
    got = {x.way: x.inside / m - x.chance for x in rows}
    return [got.get(i, 0.0) for i in range(len(pairs))]


def modularity(links: DataFrame, m: float) -> float:
    """links: (a, b, w) between groups, a = b inside one, each undirected edge once."""
    return modularities(links, m, ("a", "b"))[0]


def _degrees(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("c"), "w").unionByName(links.select(F.col("b").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("k"))


def _renamed(links: DataFrame, into: DataFrame) -> DataFrame:
    """links after each group c of into (c, to) has become the group to; others stay."""
    x = links.join(into.select(F.col("c").alias("a"), F.col("to").alias("_a")), "a", "left").join(into.select(F.col("c").alias("b"), F.col("to").alias("_b")), "b", "left")
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    return x.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _best_merges(links: DataFrame, m: float) -> DataFrame:
    """(c, to, gain): the neighbour with which each group gains most, of groups that gain at all."""
    k = _degrees(links)
    g = links.where("a <> b").join(k.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b")
    g = g.withColumn("gain", F.col("w") / m - F.col("ka") * F.col("kb") / (2 * m * m)).where(F.col("gain") > LEAST)
    # Ties go to the same pair from both of its sides.
    rank = F.struct("gain", (-F.col("a")).alias("x"), (-F.col("b")).alias("y")).alias("r")
    sides = g.select(F.col("a").alias("c"), F.col("b").alias("to"), rank).unionByName(g.select(F.col("b").alias("c"), F.col("a").alias("to"), rank))
    return sides.groupBy("c").agg(F.max(F.struct("r", "to")).alias("x")).select("c", "x.to", F.col("x.r.gain").alias("gain"))


def _joining(best: DataFrame) -> DataFrame:
    """(c, to, mutual): the groups c that become the group to, by whom each (c, to, gain) would best merge with.

    Pairs that choose each other gain what they hope for: these are mutual. Those that choose a member of such a pair join
    it too, if all of it together gains more: so a hub takes up its neighbours in one round. Of any choices the greatest
    gain is mutual, so there is a row where there is a choice."""
    of = lambda c, to: best.select(F.col("c").alias(c), F.col("to").alias(to))
    chain = of("c", "_1").join(of("_1", "_2"), "_1", "left").join(of("_2", "_3"), "_2", "left").where("_3 = _1")
    return chain.select("c", F.least("_1", "_2").alias("to"), (F.col("_2") == F.col("c")).alias("mutual")).where("c <> to")


def _merged(links: DataFrame, own: DataFrame, m: float) -> tuple[DataFrame, DataFrame, float]:
    """links and own (node, c) after groups were merged as long as that gains."""
    q = modularity(links, m)
    for _ in range(MERGES):
        wide = written(_joining(written(_best_merges(links, m), "best")), "wide")
        n_wide, n_mutual = wide.agg(F.count("*"), F.count_if("mutual")).first()
        if not n_wide:
            break
        mutual = wide.where("mutual")
        tried = written(_renamed(links, wide), "links")
        after, into = modularity(tried, m), wide
        # What the pairs alone would give is only sought where it may decide.
        if n_mutual < n_wide and (after <= q or n_mutual * 8 >= n_wide):
            narrow = written(_renamed(links, mutual), "links")
            q_narrow = modularity(narrow, m)
            if after <= q or q_narrow >= after:
                into, tried, after = mutual, narrow, q_narrow
        links, q = tried, after
        own = written(own.join(into.select("c", "to"), "c", "left").select("node", F.coalesce("to", "c").alias("c")), "own")
    return links, own, q


def _moves(edges: DataFrame, k: DataFrame, own: DataFrame, m: float) -> DataFrame:
    """(node, c, to, gain): the group to which each node would best move, where that gains. edges: both ways; k: (node, k)
    of their degrees."""
    at = own.join(k, "node")
    size = at.groupBy("c").agg(F.sum("k").alias("size"))
    to = edges.join(own.select(F.col("node").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
    g = to.join(at, "node").join(size.select(F.col("c").alias("to"), F.col("size").alias("size_to")), "to").join(size, "c")
    inside = F.max(F.when(F.col("to") == F.col("c"), F.col("w"))).over(Window.partitionBy("node"))
    g = g.withColumn("w_own", inside).where("to <> c")
    gain: Column = (F.col("w") - F.coalesce("w_own", F.lit(0.0))) / m - F.col("k") * (F.col("size_to") - F.col("size") + F.col("k")) / (2 * m * m)
    g = g.withColumn("gain", gain).where(F.col("gain") > LEAST)
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("gain"), "to"))
    return g.withColumn("_n", best).where("_n = 1").select("node", "c", "to", "gain")


def _applied(own: DataFrame, moves: DataFrame) -> DataFrame:
    """(node, every, some): each node's group after all moves, and after those alone that are first in both their groups."""
    one = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("gain"), "node"))
    sides = moves.select("node", "to", "gain", F.explode(F.array("c", "to")).alias("g")).withColumn("_n", one)
    alone = sides.groupBy("node", "to").agg((F.max("_n") == 1).alias("alone"))
    return own.join(alone, "node", "left").select("node", F.coalesce("to", "c").alias("every"), F.when(F.col("alone"), F.col("to")).otherwise(F.col("c")).alias("some"))


def communities(edges: DataFrame) -> DataFrame:
    """(node, community) of the undirected graph of src and dst, each pair once; a community is its smallest node.

    Groups begin as single nodes. Pairs that gain most from each other merge, round by round; then nodes move to the
    group where they gain most, all at once if that raises modularity, else as many as take part in no other's group;
    then the groups merge again. Self-loops and null ends are left out; an empty graph gives an empty result.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("w", F.lit(1.0))
    e = written(e, "edges")
    m = float(e.count())
    both = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "both")
    own = written(both.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node")), "own")
    k = written(_degrees(e).withColumnRenamed("c", "node"), "degrees")
    if not m:
        return own.withColumnRenamed("c", "community")
    links, q = e, -1.0
    for _ in range(AGAIN):
        links, own, after = _merged(links, own, m)
        moved = False
        for _ in range(MOVES):
            moves = written(_moves(both, k, own, m), "moves")
            if moves.isEmpty():
                break
            now = written(_applied(own, moves), "own")
            ends = [now.select(F.col("node").alias(x), *(F.col(y).alias(f"{x}_{y}") for y in ("every", "some"))) for x in ("a", "b")]
            found = modularities(e.join(ends[0], "a").join(ends[1], "b"), m, ("a_every", "b_every"), ("a_some", "b_some"))
            taken = [(y, x) for y, x in zip(("every", "some"), found, strict=True) if x > after + LEAST]
            if not taken:
                break
            own, moved = now.select("node", F.col(taken[0][0]).alias("c")), True
            gained, after = taken[0][1] - after, taken[0][1]
            if gained < WORTH:
                break
        if moved:
            links = written(_renamed(e, own.select(F.col("node").alias("c"), F.col("c").alias("to"))), "links")
        if after <= q + WORTH:
            break
        q = after
    least = own.groupBy("c").agg(F.min("node").alias("community"))
    return own.join(least, "c").select("node", "community")
