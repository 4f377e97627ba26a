"""Entity resolution reads every event."""

import re

import duckdb

from tracewell import queries
from tracewell.operators import components, entities

SF = "/root/testdata/sf0.001"


def slow_components(pairs):
    """{node: smallest node reachable}."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        front = [] if n in out else [n]
        while front:
            x = front.pop()
            if x not in out:
                out[x] = n
                front += near[x]
    return out


def test_every_event_counts(spark):
    events = duckdb.sql(f"select event_id, user_id, props from '{SF}/events.parquet'").fetchall()
    pairs = [(f"PHONE:{u}", f"IMEI:{(re.search('[0-9]+', p) or [''])[0]}-{u // 10}") for _, u, p in events]
    want = slow_components(pairs)
    rows = queries.r01_entities(spark, SF).collect()
    assert {r.identifier: r.entity_id for r in rows} == want
    assert {r.identifier: r.component for r in components.connected_components(entities.identifier_edges(spark, SF), "a", "b").withColumnRenamed("node", "identifier").collect()} == want
    size = {e: list(want.values()).count(e) for e in set(want.values())}
    assert {(r.entity_id, r.identifiers) for r in queries.r02_entity_labels(spark, SF).collect()} == set(size.items())
    found = {r.event_id: (r.entity, r.external) for r in queries.j07_entity_lookup(spark, SF).collect()}
    assert found == {i: (want[f"PHONE:{u}"], False) for i, u, _ in events}
