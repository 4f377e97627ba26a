"""Betweenness and communities by joins, against walks over the whole graph; views and neighbourhoods."""

import heapq
import random

import pytest

from tracewell.operators import centrality, graph, modularity


def brandes(edges, sources=None):
    """Betweenness of a small directed graph, source by source."""
    near, nodes = {}, sorted({x for e in edges for x in e[:2]})
    weight = {}
    for a, b, w in edges:
        weight[a, b] = weight.get((a, b), 0) + (w or 0)
    for (a, b), w in weight.items():
        if a != b:
            near.setdefault(a, []).append((b, w or 1))
    total = dict.fromkeys(nodes, 0.0)
    for s in sources or nodes:
        dist, ways, before, order, heap, best = {}, {s: 1.0}, {s: []}, [], [(0.0, s)], {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for w, length in near.get(v, ()):
                if w not in best or d + length < best[w]:
                    best[w], ways[w], before[w] = d + length, ways[v], [v]
                    heapq.heappush(heap, (d + length, w))
                elif w not in dist and d + length == best[w]:
                    ways[w] += ways[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(nodes)
    return {v: x / max(1, (n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_against_shortest_paths(spark):
    r = random.Random(1)
    edges = [(r.randrange(24), r.randrange(24), float(r.randint(1, 4))) for _ in range(80)] + [(40, 41, 2.0), (5, 5, 1.0), (1, 2, None), (3, 4, 0.0)]
    got = {x.node: x.betweenness for x in centrality.betweenness(spark.createDataFrame(edges, "src long, dst long, distance double")).collect()}
    want = brandes(edges)
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_betweenness_from_some_sources(spark):
    line = [(i, i + 1, 1.0) for i in range(6)]
    df = spark.createDataFrame(line, "src long, dst long, distance double")
    some = {x.node: x.betweenness for x in centrality.betweenness(df, exact=3, pivots=7).collect()}
    whole = {x.node: x.betweenness for x in centrality.betweenness(df).collect()}
    assert some == pytest.approx(whole) and whole == pytest.approx(brandes(line))
    few = centrality.betweenness(df, exact=3, pivots=2).collect()
    assert len(few) == 7
    assert centrality.betweenness(df.where("false")).count() == 0
    assert [x.betweenness for x in centrality.betweenness(df.where("src = 0")).collect()] == [0.0, 0.0]


def quality(edges, c):
    m, k, inside = len(edges), {}, 0
    for x, y in edges:
        k[c[x]] = k.get(c[x], 0) + 1
        k[c[y]] = k.get(c[y], 0) + 1
        inside += c[x] == c[y]
    return inside / m - sum((v / (2 * m)) ** 2 for v in k.values())


def greedy(edges):
    """Groups merged pair by pair, each time those that gain most."""
    c, m = {x: x for e in edges for x in e}, len(edges)
    while True:
        w, k = {}, {}
        for x, y in edges:
            a, b = sorted((c[x], c[y]))
            k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
            if a != b:
                w[a, b] = w.get((a, b), 0) + 1
        gains = [(v / m - k[a] * k[b] / (2 * m * m), -a, -b) for (a, b), v in w.items()]
        if not gains or max(gains)[0] <= 1e-12:
            return c
        _, a, b = max(gains)
        c = {x: -a if y == -b else y for x, y in c.items()}


def planted(seed):
    r, edges = random.Random(seed), set()
    for _ in range(150):
        x = r.randrange(40)
        y = x // 10 * 10 + r.randrange(10) if r.random() < 0.7 else r.randrange(40)
        if x != y:
            edges.add((min(x, y), max(x, y)))
    return sorted(edges)


STARS = [(0, i) for i in range(1, 30)] + [(50, i) for i in range(51, 70)] + [(0, 50)]
CLIQUES = [(g * 10 + i, g * 10 + j) for g in range(4) for i in range(5) for j in range(i)] + [(g * 10, (g + 1) % 4 * 10) for g in range(4)]


@pytest.mark.parametrize("edges", [planted(0), planted(2), STARS, CLIQUES], ids=["planted", "planted again", "stars", "cliques"])
def test_communities_are_as_good_as_greedy_merging(spark, edges):
    df = spark.createDataFrame([*edges, (edges[0][1], edges[0][0]), (edges[0][0], edges[0][0])], "src long, dst long")
    got = {x.node: x.community for x in modularity.communities(df).collect()}
    assert set(got) == {x for e in edges for x in e}
    assert quality(edges, got) >= quality(edges, greedy(edges)) - 1e-9
    assert all(c == min(n for n, d in got.items() if d == c) for c in got.values())
    if edges is CLIQUES:
        assert len(set(got.values())) == 4


def test_rounds_of_communities_write_little(spark, monkeypatch):
    """A round of moves writes its moves and the groups after them, once, and both ways to apply them are weighed in one
    job; links are written by merges and once after the moves."""
    rng = random.Random(9)
    pairs = {(a, b) for a in range(60) for b in rng.sample(range(60), 3) if a < b}
    labels, plain = [], modularity.written
    monkeypatch.setattr(modularity, "written", lambda df, label: labels.append(label) or plain(df, label))
    got = {x.node: x.community for x in modularity.communities(spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    n = {x: labels.count(x) for x in labels}
    assert n["moves"] > 1 and n["own"] <= 1 + n["best"] + n["moves"] and n["links"] <= 2 * n["wide"] + modularity.AGAIN

    rows = [(got[a], got[b], 0, 1, 1.0) for a, b in pairs]
    links = spark.createDataFrame(rows, "a long, b long, x long, y long, w double")
    ends = {c: sum((a == c) + (b == c) for a, b, *_ in rows) for c in set(got.values())}
    want = sum(a == b for a, b, *_ in rows) / len(rows) - sum((k / (2 * len(rows))) ** 2 for k in ends.values())
    found = modularity.modularities(links, float(len(rows)), ("a", "b"), ("x", "y"))
    assert abs(found[0] - want) < 1e-9 and abs(found[1] + 0.5) < 1e-9


def test_communities_of_nothing(spark):
    assert modularity.communities(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_views_and_neighbourhoods(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (1, 9), (1, 2), (8, 8)], "src long, dst long")
    nodes, inner = graph.top_view(edges, 3)
    assert [r.node for r in nodes.collect()] == [1, 2, 3] and inner.count() == 3
    focus = spark.createDataFrame([(3,), (3,), (77,)], "node long")
    assert {r.node: r.steps for r in graph.ego(edges, focus, 2).collect()} == {3: 0, 77: 0, 2: 1, 4: 1, 1: 2, 5: 2}
    assert {r.node for r in graph.ego(edges, focus, 0).collect()} == {3, 77}
