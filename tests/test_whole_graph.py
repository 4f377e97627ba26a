"""The structural rules over the whole graph: the floor is at most the median, cycles have up to six entities."""

import datetime as dt

import duckdb

from tracewell import queries
from tracewell.operators import graph, transfers
from tracewell.plans.adapter import EVENTS_SQL

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 12)


def slow_graph(sf):
    """{src: {dst: last time}} over the upper median or more, of the events' debits."""
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    rows = con.sql(f"WITH {EVENTS_SQL} SELECT entity_id, cp, amount, epoch_us(ts_start), ref_no FROM ev WHERE direction = 'DEBIT' AND entity_id <> cp ORDER BY ref_no").fetchall()
    amounts = sorted(r[2] for r in rows if r[2] is not None)
    floor = min(10_000, amounts[len(amounts) // 2])
    g = {}
    for s, d, amount, t, _ in rows:
        if amount is None or amount >= floor:
            g.setdefault(s, {})[d] = t
    return g


def slow_cycles(g, longest=6):
    found = []

    def walk(path):
        for n in g.get(path[-1], ()):
            if n == path[0] and len(path) > 1:
                found.append(tuple(path))
            elif n > path[0] and n not in path and len(path) < longest:
                walk([*path, n])

    for s in g:
        walk([s])
    return found


def slow_chains(g, span=48 * 3_600_000_000):
    return {x for a in g for b, t in g[a].items() for c, t2 in g.get(b, {}).items() if c != a and t2 - t <= span for d, t3 in g.get(c, {}).items() if d not in (a, b) and t3 - t <= span for x in (a, b, c, d)}


def test_whole_graph_equals_brute_force(spark):
    g = slow_graph(SF)
    want = {}
    for path in slow_cycles(g):
        for x in path:
            n, shortest = want.get(x, (0, 9))
            want[x] = (n + 1, min(shortest, len(path)))
    assert {r.entity_id: (r.cycles, r.shortest) for r in queries.r07_circular_flow(spark, SF).collect()} == want
    assert {r.entity_id for r in queries.r08_layering(spark, SF).collect()} == slow_chains(g)
    flags = queries.r12_rule_flags(spark, SF).collect()
    assert {r.entity_id: r.value for r in flags if r.rule == "circular_flow"} == {x: n for x, (n, _) in want.items()}
    assert {r.entity_id for r in flags if r.rule == "layering"} == slow_chains(g)


def test_a_ring_of_six_small_transfers(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i), i, "purchase", 20.0, f'{{"k": {i % 6 + 1}}}') for i in range(1, 7)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.entity_id, r.cycles, r.shortest) for r in queries.r07_circular_flow(spark, str(tmp_path)).collect()} == {(i, 1, 6) for i in range(1, 7)}
    assert {r.entity_id for r in queries.r08_layering(spark, str(tmp_path)).collect()} == set(range(1, 7))
    scores = {r.entity_id: r.raw_weight for r in queries.r14_risk_scores(spark, str(tmp_path)).collect()}
    assert scores == dict.fromkeys(range(1, 7), 0.3)


def test_adaptive_floor(spark):
    schema = "amount double, asset string"
    left = lambda rows, floor: sorted((r.amount or 0, r.asset) for r in transfers.over_adaptive_floor(spark.createDataFrame(rows, schema), floor).collect())
    small = [(1.0, "INR"), (2.0, "INR"), (3.0, "INR"), (4.0, "INR"), (None, "INR"), (0.1, "BTC")]
    assert left(small, 10_000) == [(0, "INR"), (0.1, "BTC"), (3.0, "INR"), (4.0, "INR")]
    assert left(small, 2) == [(0, "INR"), (0.1, "BTC"), (2.0, "INR"), (3.0, "INR"), (4.0, "INR")]
    assert len(left(small, 0)) == 6 and left([(0.1, "BTC")], 10_000) == [(0.1, "BTC")]


def test_chains_against_all_chains(spark):
    """Random graphs with hubs and edges without time: the same entities as from listing every chain."""
    import random

    for seed in range(5):
        r = random.Random(seed)
        edges = {}
        for _ in range(r.choice([8, 25, 60])):
            a, b = r.choice([0, 0, r.randrange(9)]), r.choice([1, r.randrange(9)])
            if a != b:
                edges[a, b] = r.choice([None, r.randrange(6), r.randrange(6), r.randrange(6)])
        span = 2
        want = set()
        for (a, b), t1 in edges.items():
            for (b2, c), t2 in edges.items():
                if b2 != b or c == a or t1 is not None and t2 is not None and t2 - t1 > span:
                    continue
                for (c2, d), t3 in edges.items():
                    if c2 == c and d not in (a, b) and (t1 is None or t3 is None or t3 - t1 <= span):
                        want |= {a, b, c, d}
        rows = [(a, b, None if t is None else t * 3_600_000_000) for (a, b), t in edges.items()]
        got = {x.entity_id for x in graph.layering(spark.createDataFrame(rows, "src long, dst long, t long"), span).collect()}
        assert got == want
