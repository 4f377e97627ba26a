"""The registered queries of the fusion operators, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.operators import anomaly, centrality, correlate, entities, features, graph, ledger, modularity, reports, rules, search, similar, transfers
from tracewell.plans.adapter import EVENTS_SQL, canonical_events
from tracewell.plans.adapter import ledger as ledger_rows
from tracewell.scratch import table, written
from tracewell.sources import grids, html_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- coincidences


def _hits_sql(w: int) -> str:
    return f"""{EVENTS_SQL},
    tx AS (SELECT DISTINCT e.* EXCLUDE (cp), unnest([entity_id, cp]) AS eid FROM ev e WHERE event_type = 'TRANSACTION'),
    ca AS (SELECT DISTINCT e.* EXCLUDE (cp), unnest([entity_id, cp]) AS eid FROM ev e WHERE event_type = 'CALL'),
    near AS (SELECT t.eid, t.event_id AS txn_id, t.ts_start AS txn_ts, t.amount, t.direction, c.event_id AS call_id, c.ts_start AS call_ts,
             row_number() OVER (PARTITION BY t.eid, t.event_id ORDER BY abs(epoch_us(c.ts_start) - epoch_us(t.ts_start)), c.ts_start, c.event_id) AS rn
             FROM tx t JOIN ca c ON t.eid = c.eid AND c.ts_start BETWEEN t.ts_start - to_minutes({w}) AND t.ts_start + to_minutes({w}) WHERE t.eid IS NOT NULL),
    sess AS (SELECT n.eid, n.txn_id, s.event_id AS session_id, s.ts_start AS session_start,
             row_number() OVER (PARTITION BY n.eid, n.txn_id ORDER BY s.ts_start, s.event_id) AS rn
             FROM near n JOIN ev s ON s.event_type = 'IP_SESSION' AND s.entity_id = n.eid AND s.ts_start <= n.txn_ts + to_minutes({w}) AND s.ts_end >= n.txn_ts - to_minutes({w}) WHERE n.rn = 1),
    hits AS (SELECT n.eid AS entity_id, n.txn_id, txn_ts, amount, direction, call_id, call_ts, session_id, session_start,
             CASE WHEN session_id IS NULL THEN 'MEDIUM' ELSE 'STRONG' END AS tier
             FROM near n LEFT JOIN sess s ON s.eid = n.eid AND s.txn_id = n.txn_id AND s.rn = 1 WHERE n.rn = 1)"""


@query(f"WITH {_hits_sql(10)} SELECT * FROM hits")
def j06_correlate_10min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlate(canonical_events(spark, sf_dir), 10)


@query(f"WITH {_hits_sql(60)} SELECT * FROM hits")
def j06_correlate_60min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.correlate(canonical_events(spark, sf_dir), 60)


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT event_id, unnest([entity_id, cp]) AS eid FROM ev WHERE event_type = 'CALL' AND entity_id IS NOT NULL")
def j03_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.participants(canonical_events(spark, sf_dir), "CALL").select("event_id", "eid")


@query(
    f"""WITH {_hits_sql(60)} SELECT txn_id, entity_id, 'Transfer of ' || printf('%.2f', amount) || ' at ' || strftime(txn_ts, '%Y-%m-%d %H:%M:%S') || ' coincided with a call at ' || strftime(call_ts, '%Y-%m-%d %H:%M:%S')
    || CASE tier WHEN 'STRONG' THEN ' while online (within 60 min)' ELSE ' (within 60 min, no session)' END AS explanation FROM hits"""
)
def f30_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.explain(correlate.correlate(canonical_events(spark, sf_dir), 60), 60).select("txn_id", "entity_id", "explanation")


@query(f"WITH {_hits_sql(60)} SELECT entity_id, count(*) FILTER (tier = 'STRONG') AS strong, count(*) FILTER (tier = 'MEDIUM') AS medium FROM hits GROUP BY entity_id")
def a07_coincidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = correlate.correlate(canonical_events(spark, sf_dir), 60)
    return h.groupBy("entity_id").agg(F.count(F.when(F.col("tier") == "STRONG", 1)).alias("strong"), F.count(F.when(F.col("tier") == "MEDIUM", 1)).alias("medium"))


# ---------------------------------------------------------------- transfers

TRANSFERS_SQL = f"""{EVENTS_SQL},
    tr AS (SELECT entity_id AS from_entity, cp AS to_entity, amount, asset, ts_start AS ts, ref_no AS ref FROM ev
           WHERE event_type = 'TRANSACTION' AND direction = 'DEBIT' AND entity_id <> cp)"""


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.build_transfers(canonical_events(spark, sf_dir).where("event_type = 'TRANSACTION'"))


@query(f"WITH {TRANSFERS_SQL} SELECT * FROM tr")
def j02_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfers(spark, sf_dir)


_LEGS = """legs AS (SELECT o_orderkey AS ref_no, o_orderkey AS event_id, o_custkey AS entity_id, o_totalprice AS amount, 'DEBIT' AS direction, o_orderdate AS ts_start FROM orders
    UNION ALL SELECT l_orderkey, l_suppkey * 100000 + l_partkey, l_suppkey, l_extendedprice, 'CREDIT', l_shipdate FROM lineitem)"""

#: A number that no customer or supplier has.
_NOBODY = -(2**62)


@query(
    f"""WITH {_LEGS}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_no ORDER BY event_id DESC) rn FROM legs WHERE direction = 'DEBIT') x WHERE rn = 1),
    c AS (SELECT ref_no, arg_max(entity_id, event_id) AS entity_id FROM legs WHERE direction = 'CREDIT' GROUP BY ref_no),
    m AS (SELECT d.entity_id AS from_entity, c.entity_id AS to_entity, d.amount, 'INR' AS asset, d.ts_start AS ts, d.ref_no AS ref FROM d JOIN c USING (ref_no) WHERE d.entity_id <> c.entity_id)
    SELECT * FROM m UNION ALL SELECT entity_id, 0, amount, 'INR', ts_start, ref_no FROM legs WHERE direction = 'DEBIT' AND ref_no NOT IN (SELECT ref FROM m)"""
)
def j01_double_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as debits against lineitem as credits; the last leg of each side under an order counts. Orders without a
    credit go to 0, which is nobody's number here though a customer may have it, so it takes no part in the matching."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_no"), F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity_id"), F.lit(_NOBODY).cast("long").alias("counterparty_entity_id"), F.col("o_totalprice").alias("amount"), F.lit("DEBIT").alias("direction"), F.col("o_orderdate").alias("ts_start"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref_no"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("event_id"), F.col("l_suppkey").alias("entity_id"), F.lit(None).cast("long").alias("counterparty_entity_id"), F.col("l_extendedprice").alias("amount"), F.lit("CREDIT").alias("direction"), F.col("l_shipdate").alias("ts_start"))
    found = transfers.build_transfers(o.unionByName(li).withColumn("asset", F.lit("INR")))
    return found.withColumn("to_entity", F.when(F.col("to_entity") == _NOBODY, 0).otherwise(F.col("to_entity")))


@query(f"WITH {TRANSFERS_SQL} SELECT n, amount AS median FROM (SELECT amount, count(*) OVER () AS n, row_number() OVER (ORDER BY amount) AS rn FROM tr WHERE amount IS NOT NULL) x WHERE rn = n // 2 + 1")
def a22_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.upper_median(_transfers(spark, sf_dir))


@query(f"WITH {TRANSFERS_SQL} SELECT * FROM tr WHERE asset <> 'INR' OR amount IS NULL OR amount >= 100")
def f28_amount_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.over_floor(_transfers(spark, sf_dir), 100.0)


@query(f"WITH {TRANSFERS_SQL} SELECT from_entity AS src, to_entity AS dst, round(sum(amount), 2) AS total, count(*) AS transfers FROM tr GROUP BY 1, 2")
def a09_money_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.money_edges(_transfers(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT entity_id AS src, cp AS dst, count(*) AS calls FROM ev WHERE event_type = 'CALL' AND entity_id IS NOT NULL AND cp IS NOT NULL GROUP BY 1, 2")
def a08_communication_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communication_edges(canonical_events(spark, sf_dir))


@query(f"""WITH {TRANSFERS_SQL}, e AS (SELECT DISTINCT from_entity AS s, to_entity AS d FROM tr), x AS (SELECT s AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT d, 1, 0 FROM e)
    SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM x GROUP BY node""")
def r16_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.money_edges(_transfers(spark, sf_dir)))


#: The edges of the structural rules: transfers of the smaller of the configured floor and the upper median.
_STRONG = "amount >= least(150, (SELECT list_sort(list(amount))[count(*) // 2 + 1] FROM tr))"
_DIGRAPH = f"""{TRANSFERS_SQL}, g AS (SELECT from_entity AS s, to_entity AS d, arg_max(epoch_us(ts), ref) AS t FROM tr WHERE {_STRONG} GROUP BY 1, 2)"""


def _cycles_sql(longest: int) -> str:
    """Each simple cycle of two to `longest` edges once, from its smallest node, as a list p: one join per edge."""
    parts = []
    for n in range(2, longest + 1):
        nodes = ["e1.s", *(f"e{k}.d" for k in range(1, n))]
        joins = " ".join(f"JOIN g e{k} ON e{k}.s = e{k - 1}.d" for k in range(2, n + 1))
        apart = [f"e1.s < {x}" for x in nodes[1:]] + [f"{x} <> {y}" for i, x in enumerate(nodes[1:]) for y in nodes[i + 2 :]]
        parts.append(f"SELECT [{', '.join(nodes)}] AS p FROM g e1 {joins} WHERE e{n}.d = e1.s AND {' AND '.join(apart)}")
    return " UNION ALL ".join(parts)


def _digraph(tr: DataFrame) -> DataFrame:
    """The graph of the structural rules, over the smaller of the configured floor and the median; written, as several joins read it."""
    return written(graph.digraph(transfers.over_adaptive_floor(tr, _T.floor)), "digraph")


def _strong_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digraph(_transfers(spark, sf_dir))


@query(f"""WITH {_DIGRAPH}, c AS ({_cycles_sql(6)}), u AS (SELECT unnest(p) AS entity_id, len(p) AS n FROM c)
    SELECT entity_id, count(*) AS cycles, min(n)::INT AS shortest FROM u GROUP BY entity_id""")
def r07_circular_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.circular_flow(_strong_graph(spark, sf_dir), _T.cycle_length)


@query(f"""WITH {_DIGRAPH} SELECT DISTINCT unnest([a.s, a.d, b.d, c.d]) AS entity_id FROM g a JOIN g b ON b.s = a.d AND b.d <> a.s AND b.t - a.t <= 172800000000
    JOIN g c ON c.s = b.d AND c.d <> a.s AND c.d <> a.d AND c.t - a.t <= 172800000000""")
def r08_layering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layering(_strong_graph(spark, sf_dir), _T.span_hours)


@query()
def r15_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every node of up to 800, else from 200 of them; a test holds it against shortest paths node by node."""
    e = graph.money_edges(_transfers(spark, sf_dir)).select("src", "dst", F.col("total").alias("distance"))
    return centrality.betweenness(e)


@query()
def r17_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test holds their modularity against that of greedy merging."""
    return modularity.communities(graph.money_edges(_transfers(spark, sf_dir)))


_GRAPH = f"""{TRANSFERS_SQL}, ge AS (SELECT from_entity AS src, to_entity AS dst, 'MONEY' AS kind, round(sum(amount), 2) AS amount, count(*) AS count FROM tr GROUP BY 1, 2
    UNION ALL SELECT entity_id, cp, 'COMMUNICATION', NULL, count(*) FROM ev WHERE event_type = 'CALL' AND entity_id IS NOT NULL AND cp IS NOT NULL GROUP BY 1, 2),
    pe AS (SELECT DISTINCT src, dst FROM ge), ends AS (SELECT src AS node, 1 AS o FROM pe UNION ALL SELECT dst, 0 FROM pe), nd AS (SELECT node, count(*) AS degree, sum(o) = 0 AS external FROM ends GROUP BY node)"""


def _whole_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.payload(graph.money_edges(_transfers(spark, sf_dir)), graph.communication_edges(canonical_events(spark, sf_dir)))


@query(f"WITH {_GRAPH} SELECT * FROM nd")
def r18_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_graph(spark, sf_dir)[0]


@query(f"WITH {_GRAPH} SELECT * FROM ge")
def r18_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_graph(spark, sf_dir)[1]


@query(f"WITH {_GRAPH}, top AS (SELECT node FROM nd ORDER BY degree DESC, node LIMIT 50) SELECT ge.* FROM ge WHERE src IN (FROM top) AND dst IN (FROM top)")
def l08_top_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a large graph: the edges between its 50 nodes of highest degree."""
    return graph.top_view(_whole_graph(spark, sf_dir)[1], 50)[1]


@query(f"""WITH {_GRAPH}, u AS (SELECT src AS a, dst AS b FROM pe UNION SELECT dst, src FROM pe), f AS (SELECT node FROM nd WHERE node % 50 = 7),
    s1 AS (SELECT DISTINCT b AS node FROM u WHERE a IN (FROM f) AND b NOT IN (FROM f)), s2 AS (SELECT DISTINCT b AS node FROM u WHERE a IN (FROM s1) AND b NOT IN (FROM f) AND b NOT IN (FROM s1))
    SELECT node, 0 AS steps FROM f UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2""")
def u06_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is within two steps of the nodes in focus, over money and calls in either direction."""
    nodes, edges = _whole_graph(spark, sf_dir)
    return graph.ego(edges, nodes.where("node % 50 = 7"), 2)


# ---------------------------------------------------------------- windows and features


@query(f"""WITH {EVENTS_SQL} SELECT entity_id, max(n) AS most FROM (SELECT entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY ts_start RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS n
    FROM ev WHERE event_type = 'CALL') x GROUP BY entity_id""")
def w01_calls_in_an_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.max_in_window(canonical_events(spark, sf_dir).where("event_type = 'CALL'"), 60)


@query("""SELECT o_custkey AS account, coalesce(max(g), 0.0) AS gap_days FROM (SELECT o_custkey, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))) / 86400000000.0 AS g FROM orders) x GROUP BY 1""")
def w02_longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.max_gap_days(ledger_rows(spark, sf_dir), "account", "ts")


def _forward_sql(minutes: int) -> str:
    return f"""SELECT entity_id, round(max(least(1.0, out / amount)), 3) AS forwarded FROM (SELECT *, sum(CASE direction WHEN 'DEBIT' THEN amount ELSE 0 END) OVER (PARTITION BY entity_id, asset ORDER BY ts_start
        RANGE BETWEEN CURRENT ROW AND INTERVAL {minutes} MINUTES FOLLOWING) AS out FROM ev WHERE event_type = 'TRANSACTION') x WHERE direction = 'CREDIT' AND amount > 0 GROUP BY entity_id"""


@query(f"WITH {EVENTS_SQL} {_forward_sql(120)}")
def w03_rapid_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rapid_forward(canonical_events(spark, sf_dir).where("event_type = 'TRANSACTION'"), 120)


@query("""SELECT account, most FROM (SELECT account, max(n) AS most FROM (SELECT o_custkey AS account, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS n
    FROM orders WHERE o_totalprice >= 450000 AND o_totalprice < 500000) x GROUP BY account) y WHERE most >= 2""")
def w04_structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ledger_rows(spark, sf_dir).where("amount >= 450000 AND amount < 500000")
    return features.max_in_window(near, 365 * 24 * 60, "account", "ts").where("most >= 2")


@query(f"WITH {EVENTS_SQL} SELECT entity_id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY ts_start, event_id) AS place FROM ev")
def w05_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("ts_start", "event_id")
    return canonical_events(spark, sf_dir).select("entity_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    """WITH r AS (SELECT o_custkey AS account, o_orderkey AS event_id, o_orderdate AS ts, o_totalprice AS amount, CASE o_orderstatus WHEN 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS direction, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 1000.0 END AS balance FROM orders),
    p AS (SELECT *, lag(balance) OVER (PARTITION BY account ORDER BY ts, event_id) AS prev FROM r)
    SELECT account, count(*) AS checked, count(*) FILTER (abs(prev + CASE direction WHEN 'CREDIT' THEN amount ELSE -amount END - balance) > 1) AS breaks,
           round(1 - count(*) FILTER (abs(prev + CASE direction WHEN 'CREDIT' THEN amount ELSE -amount END - balance) > 1) / count(*), 4) AS consistency FROM p WHERE prev IS NOT NULL GROUP BY account"""
)
def w06_balance_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ledger_rows(spark, sf_dir).withColumn("balance", F.when(F.col("event_id") % 3 == 0, F.col("amount")).otherwise(1000.0))
    return ledger.balance_breaks(r)


@query(f"""WITH {_hits_sql(60)}, tr AS (SELECT entity_id AS f, cp AS t, amount, asset, ts_start AS ts FROM ev WHERE direction = 'DEBIT' AND entity_id <> cp),
    own AS (SELECT DISTINCT entity_id FROM ev WHERE event_type = 'TRANSACTION'),
    fl AS (SELECT entity_id, asset, direction, amount, ts_start AS ts, false AS ft FROM ev WHERE event_type = 'TRANSACTION'
           UNION ALL SELECT f, asset, 'DEBIT', amount, ts, true FROM tr WHERE f NOT IN (SELECT entity_id FROM own) UNION ALL SELECT t, asset, 'CREDIT', amount, ts, true FROM tr WHERE t NOT IN (SELECT entity_id FROM own)),
    b AS (SELECT entity_id, count(*) AS total_events, count(*) FILTER (hour(ts_start) <= 5 OR hour(ts_start) >= 23) AS night_events, count(*) FILTER (event_type = 'TRANSACTION') AS txn_count FROM ev GROUP BY 1),
    m AS (SELECT entity_id, sum(CASE direction WHEN 'CREDIT' THEN amount ELSE 0 END) AS total_in, sum(CASE direction WHEN 'DEBIT' THEN amount ELSE 0 END) AS total_out, bool_or(ft) AS ft FROM fl GROUP BY 1),
    fi AS (SELECT t AS entity_id, count(DISTINCT f) AS fan_in FROM tr GROUP BY 1), fo AS (SELECT f AS entity_id, count(DISTINCT t) AS fan_out FROM tr GROUP BY 1),
    c AS (SELECT entity_id, count(*) FILTER (tier = 'STRONG') AS strong, count(*) FILTER (tier = 'MEDIUM') AS medium FROM hits GROUP BY 1),
    ids AS (SELECT entity_id FROM b UNION SELECT entity_id FROM m UNION SELECT entity_id FROM fi UNION SELECT entity_id FROM fo UNION SELECT entity_id FROM c)
    SELECT entity_id, coalesce(total_events, 0) AS total_events, coalesce(txn_count, 0) AS txn_count, round(coalesce(total_in, 0), 2) AS total_in, round(coalesce(total_out, 0), 2) AS total_out, coalesce(ft, false) AS from_transfers_only,
           coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(strong, 0) AS strong, coalesce(medium, 0) AS medium, round(CASE WHEN total_events > 0 THEN night_events / total_events ELSE 0 END, 6) AS night_ratio
    FROM ids LEFT JOIN b USING (entity_id) LEFT JOIN m USING (entity_id) LEFT JOIN fi USING (entity_id) LEFT JOIN fo USING (entity_id) LEFT JOIN c USING (entity_id) WHERE entity_id IS NOT NULL""")
def a01_entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    f = features.entity_features(e, _transfers(spark, sf_dir), correlate.correlate(e, 60))
    return f.select("entity_id", "total_events", "txn_count", F.round("total_in", 2).alias("total_in"), F.round("total_out", 2).alias("total_out"), "from_transfers_only", "fan_in", "fan_out", "strong", "medium", F.round("night_ratio", 6).alias("night_ratio"))


# ---------------------------------------------------------------- rules and score

_FLAGS_SQL = f"""WITH {_hits_sql(60)}, tr AS (SELECT entity_id AS f, cp AS t, amount, asset, ts_start AS ts, ref_no FROM ev WHERE direction = 'DEBIT' AND entity_id <> cp),
    own AS (SELECT DISTINCT entity_id FROM ev WHERE event_type = 'TRANSACTION'),
    fl AS (SELECT entity_id, asset, direction, amount, ts_start AS ts FROM ev WHERE event_type = 'TRANSACTION'
           UNION ALL SELECT f, asset, 'DEBIT', amount, ts FROM tr WHERE f NOT IN (SELECT entity_id FROM own) UNION ALL SELECT t, asset, 'CREDIT', amount, ts FROM tr WHERE t NOT IN (SELECT entity_id FROM own)),
    fw AS (SELECT entity_id, round(max(least(1.0, out / amount)), 3) AS forwarded FROM (SELECT *, sum(CASE direction WHEN 'DEBIT' THEN amount ELSE 0 END) OVER (PARTITION BY entity_id, asset ORDER BY ts
           RANGE BETWEEN CURRENT ROW AND INTERVAL 1440 MINUTES FOLLOWING) AS out FROM fl) x WHERE direction = 'CREDIT' AND amount > 0 GROUP BY entity_id),
    fi AS (SELECT t AS entity_id, count(DISTINCT f) AS fan_in FROM tr GROUP BY 1),
    co AS (SELECT entity_id, count(*) FILTER (tier = 'STRONG') AS strong, count(*) AS n FROM hits GROUP BY 1),
    cb AS (SELECT entity_id, max(n) AS most FROM (SELECT entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY ts_start RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW) AS n FROM ev WHERE event_type = 'CALL') x GROUP BY 1),
    da AS (SELECT entity_id, max(g) AS gap FROM (SELECT entity_id, (epoch_us(ts_start) - epoch_us(lag(ts_start) OVER (PARTITION BY entity_id ORDER BY ts_start))) / 86400000000.0 AS g FROM ev WHERE event_type = 'TRANSACTION') x GROUP BY 1),
    g AS (SELECT f AS s, t AS d, arg_max(epoch_us(ts), ref_no) AS t FROM tr WHERE {_STRONG} GROUP BY 1, 2),
    cy AS ({_cycles_sql(6)}),
    la AS (SELECT DISTINCT unnest([a.s, a.d, b.d, c.d]) AS entity_id FROM g a JOIN g b ON b.s = a.d AND b.d <> a.s AND b.t - a.t <= 172800000000 JOIN g c ON c.s = b.d AND c.d <> a.s AND c.d <> a.d AND c.t - a.t <= 172800000000),
    flags AS (SELECT entity_id, 'rapid_in_out' AS rule, 0.2::DOUBLE AS weight, forwarded::DOUBLE AS value FROM fw WHERE forwarded >= 0.8
      UNION ALL SELECT entity_id, 'mule_account', 0.15, forwarded FROM fw JOIN fi USING (entity_id) WHERE fan_in >= 5 AND forwarded >= 0.7
      UNION ALL SELECT entity_id, 'call_transfer_coincidence', CASE WHEN strong > 0 THEN 0.15 ELSE 0.075 END, n FROM co
      UNION ALL SELECT entity_id, 'comm_burst', 0.1, most FROM cb WHERE most >= 2
      UNION ALL SELECT entity_id, 'dormant_activation', 0.1, gap FROM da WHERE gap >= 20
      UNION ALL SELECT entity_id, 'circular_flow', 0.15, count(*) FROM (SELECT unnest(p) AS entity_id FROM cy) x GROUP BY 1
      UNION ALL SELECT entity_id, 'layering', 0.15, 1 FROM la),
    ids AS (SELECT entity_id FROM ev WHERE entity_id IS NOT NULL UNION SELECT entity_id FROM fi UNION SELECT f FROM tr UNION SELECT entity_id FROM co),
    sc AS (SELECT entity_id, round(coalesce(sum(weight), 0), 6) AS raw_weight, count(rule) AS typologies_fired FROM ids LEFT JOIN flags USING (entity_id) GROUP BY entity_id),
    scores AS (SELECT *, round(100 * (0.7 * least(1.0, raw_weight)), 1) AS risk_score, raw_weight > 1 AS saturated, false AS ml_scored FROM sc),
    banded AS (SELECT *, CASE WHEN risk_score BETWEEN 70 AND 100 THEN 'high' WHEN risk_score BETWEEN 40 AND 69 THEN 'medium' ELSE 'low' END AS band FROM scores)"""

_T = rules.Thresholds(rapid_minutes=1440, mule_minutes=1440, mule_fan_in=5, calls_per_hour=2, dormant_days=20)


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = canonical_events(spark, sf_dir)
    tr = _transfers(spark, sf_dir)
    f = written(features.entity_features(e, tr, correlate.correlate(e, 60)), "features")  # read by five rules
    flows = features.flows_with_counterparties(e.where("event_type = 'TRANSACTION'"), tr)
    parts = [rules.structuring(flows, _T), rules.rapid_in_out(flows, _T), rules.mule_account(flows, f, _T), rules.coincidence(f, _T), rules.comm_burst(f, _T), rules.dormant_activation(f, _T)]
    g = _digraph(tr)
    parts += [rules.member_flags(graph.circular_flow(g, _T.cycle_length), "circular_flow", _T, "cycles"), rules.member_flags(graph.layering(g, _T.span_hours).withColumn("n", F.lit(1)), "layering", _T, "n")]
    return f, written(rules.run_all(parts), "flags")


@query(f"{_FLAGS_SQL} SELECT entity_id, rule, weight, round(value, 4) AS value FROM flags")
def r12_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)[1].select("entity_id", "rule", "weight", F.round("value", 4).alias("value"))


@query(f"{_FLAGS_SQL} SELECT entity_id, risk_score, band, typologies_fired, raw_weight, saturated, ml_scored FROM banded")
def r14_risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, flags = _flags(spark, sf_dir)
    return rules.score(f, flags)


@query(f"{_FLAGS_SQL} SELECT entity_id, risk_score, band, typologies_fired, raw_weight, saturated, ml_scored FROM banded ORDER BY risk_score DESC, typologies_fired DESC, raw_weight DESC, entity_id LIMIT 20")
def l01_risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, flags = _flags(spark, sf_dir)
    return rules.ranked(rules.score(f, flags), 20)


@query(f"""{_FLAGS_SQL} SELECT entity_id, {", ".join(f"round(max(CASE rule WHEN '{r}' THEN weight END) * 100, 2) AS {r}" for r in sorted(rules.Thresholds().weights))} FROM flags GROUP BY entity_id""")
def a18_heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.heat_map(_flags(spark, sf_dir)[1], sorted(_T.weights))


@query(f"{_FLAGS_SQL} SELECT rule, max(weight) AS max_weight, count(DISTINCT entity_id) AS entities, count(*) AS evidence FROM flags GROUP BY rule")
def a19_rule_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_rollup(_flags(spark, sf_dir)[1])


@query(f"WITH {EVENTS_SQL} SELECT entity_id, forwarded FROM ({_forward_sql(60)}) y WHERE forwarded >= 0.8")
def r05_rapid_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = canonical_events(spark, sf_dir).where("event_type = 'TRANSACTION'")
    return rules.rapid_in_out(flows, rules.Thresholds()).select("entity_id", F.col("value").alias("forwarded"))


@query("""SELECT o_custkey AS entity_id, round(max(g), 6) AS gap_days FROM (SELECT o_custkey, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate))) / 86400000000.0 AS g FROM orders) x GROUP BY 1 HAVING max(g) >= 365""")
def r11_dormant_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = features.max_gap_days(ledger_rows(spark, sf_dir), "account", "ts").select(F.col("account").alias("entity_id"), F.col("gap_days").alias("max_dormancy_days"))
    return rules.dormant_activation(g, rules.Thresholds(dormant_days=365)).select("entity_id", F.round("value", 6).alias("gap_days"))


@query(f"WITH {TRANSFERS_SQL} SELECT to_entity AS entity_id, count(DISTINCT from_entity) AS fan_in FROM tr GROUP BY 1 HAVING count(DISTINCT from_entity) >= 5")
def a04_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transfers(spark, sf_dir).groupBy(F.col("to_entity").alias("entity_id")).agg(F.count_distinct("from_entity").alias("fan_in")).where("fan_in >= 5")


# ---------------------------------------------------------------- entities

_IDS = """e AS (SELECT DISTINCT 'PHONE:' || user_id AS a, 'IMEI:' || regexp_extract(props, '([0-9]+)', 1) || '-' || (user_id // 10) AS b FROM events),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS n, a AS m FROM u UNION SELECT b, m FROM r JOIN u ON u.a = r.n), c AS (SELECT n AS identifier, min(m) AS entity_id FROM r GROUP BY n)"""


@query(f"WITH RECURSIVE {_IDS} SELECT identifier, entity_id, count(*) OVER (PARTITION BY entity_id) AS size, count(*) OVER (PARTITION BY entity_id) > 20 AS oversized FROM c")
def r01_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve(entities.identifier_edges(spark, sf_dir), cap=20)


@query(f"""WITH RECURSIVE {_IDS} SELECT entity_id, count(*) AS identifiers, string_agg(DISTINCT split_part(identifier, ':', 1), ',' ORDER BY split_part(identifier, ':', 1)) AS kinds,
    coalesce(min(CASE WHEN identifier LIKE 'PHONE:%' THEN split_part(identifier, ':', 2) END), min(split_part(identifier, ':', 2))) AS label, count(*) > 20 AS oversized FROM c GROUP BY entity_id""")
def r02_entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entity_rows(entities.resolve(entities.identifier_edges(spark, sf_dir), cap=20))


@query(f"""WITH RECURSIVE {_IDS}, q AS (SELECT event_id, 'PHONE:' || user_id AS phone FROM events)
    SELECT event_id, phone, coalesce(entity_id, phone) AS entity, entity_id IS NULL AS external FROM q LEFT JOIN c ON c.identifier = q.phone""")
def j07_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("PHONE:"), F.col("user_id").cast("string")).alias("phone"))
    return entities.lookup(rows, "phone", entities.resolve(entities.identifier_edges(spark, sf_dir)))


# ---------------------------------------------------------------- ledgers and summaries


@query("""SELECT o_orderdate::DATE AS day, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0 END) / 1e7, 4) AS inflow, round(sum(CASE o_orderstatus WHEN 'F' THEN 0 ELSE o_totalprice END) / 1e7, 4) AS outflow
    FROM orders GROUP BY 1 ORDER BY 1 LIMIT 30""")
def a10_daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily_series(ledger_rows(spark, sf_dir))


@query(f"""WITH {EVENTS_SQL} SELECT ts_start::DATE AS day, count(*) FILTER (event_type = 'TRANSACTION') AS "TRANSACTION", count(*) FILTER (event_type = 'CALL') AS "CALL", count(*) FILTER (event_type = 'IP_SESSION') AS "IP_SESSION" FROM ev GROUP BY 1""")
def a11_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.activity(canonical_events(spark, sf_dir), ["TRANSACTION", "CALL", "IP_SESSION"])


@query(f"WITH {EVENTS_SQL} SELECT event_id, event_type, entity_id FROM ev")
def f25_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    twice = e.unionByName(e.withColumn("event_id", F.col("event_id") + 1_000_000_000))
    # A reference differs between two reports of one transfer here, so it is set equal before the keys are compared.
    return ledger.dedupe(twice.withColumn("ref_no", F.when(F.col("ref_no").isNotNull(), F.col("event_id") % 1_000_000_000))).select("event_id", "event_type", "entity_id")


@query(f"""WITH {EVENTS_SQL} SELECT event_id, event_type, entity_id, ts_start FROM ev WHERE event_type = 'TRANSACTION' AND amount >= 20 AND amount <= 80 AND hour(ts_start) BETWEEN 9 AND 17""")
def f26_events_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(spark, sf_dir).where("event_type = 'TRANSACTION' AND amount BETWEEN 20 AND 80 AND hour(ts_start) BETWEEN 9 AND 17").select("event_id", "event_type", "entity_id", "ts_start")


@query(f"""WITH {EVENTS_SQL} SELECT count(*) AS events, count(*) FILTER (event_type = 'TRANSACTION') AS transactions, count(*) FILTER (event_type = 'CALL') AS calls, count(DISTINCT entity_id) AS entities, min(ts_start) AS first_seen, max(ts_start) AS last_seen, max(amount) AS max_amount FROM ev""")
def a12_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return canonical_events(spark, sf_dir).agg(F.count("*").alias("events"), kind("TRANSACTION").alias("transactions"), kind("CALL").alias("calls"), F.count_distinct("entity_id").alias("entities"), F.min("ts_start").alias("first_seen"), F.max("ts_start").alias("last_seen"), F.max("amount").alias("max_amount"))


@query("SELECT o_custkey AS src, o_totalprice AS amount, o_orderkey AS ref FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def l03_top_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select(F.col("o_custkey").alias("src"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("ref"))


# ---------------------------------------------------------------- scalar functions


@query("""SELECT c_custkey, CASE WHEN length(d) = 10 THEN '+91' || d WHEN length(d) > 10 THEN '+' || d END AS phone, CASE WHEN length(d0) >= 10 THEN right(d0, 10) END AS phone_key FROM
    (SELECT c_custkey, d0, CASE WHEN length(d0) = 12 AND d0 LIKE '91%' THEN substr(d0, 3) WHEN length(d0) = 11 AND d0 LIKE '0%' THEN substr(d0, 2) ELSE d0 END AS d FROM
    (SELECT c_custkey, regexp_replace(CASE c_custkey % 4 WHEN 0 THEN '+91 98765 ' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN '098765' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') WHEN 2 THEN '44-20-' || (7000000000 + c_custkey)::VARCHAR ELSE (c_custkey % 1000)::VARCHAR END, '[^0-9]', '', 'g') AS d0 FROM customer) x) y""")
def f05_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("+91 98765 "), n)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("०98765"), n)).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("44-20-"), (F.col("c_custkey") + 7000000000).cast("string"))).otherwise((F.col("c_custkey") % 1000).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.phone(raw).alias("phone"), scalars.phone_key(raw).alias("phone_key"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END AS amount FROM orders")
def f11_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.format_number(F.round("o_totalprice", 2), 2)
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Rs. "), n, F.lit("/-"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("INR "), n)).otherwise(F.concat(F.lit("("), n, F.lit(")")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.amount(raw).alias("amount"))


@query("SELECT event_id, date_trunc('second', ts) + to_minutes(CASE event_id % 4 WHEN 3 THEN 330 ELSE 0 END) AS ts FROM events")
def f07_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "ddMMMyyyy:HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]
    raw = F.coalesce(*(F.when(F.col("event_id") % 4 == i, F.upper(F.date_format("ts", f)) if i == 2 else F.date_format("ts", f)) for i, f in enumerate(forms)))
    t = F.when(F.col("event_id") % 4 == 3, scalars.timestamp(raw, "UTC")).otherwise(scalars.timestamp(raw))
    return table(spark, sf_dir, "events").select("event_id", t.alias("ts"))


@query(r"""SELECT doc_id, len(p) AS phones, array_to_string(p, ',') AS phone_list, len(h) AS handles, array_to_string(i, ',') AS ips FROM (SELECT doc_id,
    list_sort(list_distinct(list_filter(string_split_regex(text, '[^0-9]+'), lambda x: regexp_full_match(x, '[6-9][0-9]{9}')))) AS p,
    list_distinct(regexp_extract_all(text, '([A-Za-z0-9._-]{2,}@[A-Za-z]{2,})', 1)) AS h,
    list_sort(list_distinct(list_filter(string_split_regex(text, '[^0-9.]+'), lambda x: regexp_full_match(x, '[0-9]{1,3}([.][0-9]{1,3}){3}')))) AS i FROM documents WHERE text IS NOT NULL) x""")
def f37_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scalars.mentions(F.col("text"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", m["phones"].alias("p"), m["handles"].alias("h"), m["ips"].alias("i"))
    return d.select("doc_id", F.size("p").cast("long").alias("phones"), F.array_join("p", ",").alias("phone_list"), F.size("h").cast("long").alias("handles"), F.array_join("i", ",").alias("ips"))


# ---------------------------------------------------------------- searches


@query(f"""WITH {EVENTS_SQL} SELECT cp::VARCHAR AS key, count(*)::BIGINT AS count, count(*) AS events FROM ev WHERE event_type = 'CALL' AND hour(ts_start) >= 18 AND lower(trim(cp::VARCHAR)) NOT IN ('', '0') GROUP BY cp ORDER BY 2 DESC, key LIMIT 50""")
def q07_group_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.Search(filters=(search.Test("event_type", "eq", "call"), search.Test("hour_of_day", "gte", 18)), group_by="counterparty", limit=50)
    return search.run(canonical_events(spark, sf_dir), s)


@query(f"""WITH {EVENTS_SQL} SELECT entity_id::VARCHAR AS key, round(sum(amount), 2) AS sum_amount, count(*) AS events FROM ev WHERE direction = 'DEBIT' AND lower(entity_id::VARCHAR) <> '0' GROUP BY entity_id HAVING count(*) >= 3 ORDER BY 2 DESC, key LIMIT 30""")
def a16_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.Search(filters=(search.Test("direction", "eq", "debit"),), group_by="entity_id", aggregate="sum_amount", having=(search.Test("count", "gte", 3),), limit=30)
    return search.run(canonical_events(spark, sf_dir), s)


@query(f"""WITH {EVENTS_SQL} SELECT entity_id::VARCHAR AS key, count(*)::BIGINT AS count, count(*) AS events FROM ev WHERE lower(entity_id::VARCHAR) <> '0' GROUP BY entity_id HAVING bool_or(event_type = 'CALL') AND bool_or(event_type = 'IP_SESSION') ORDER BY 2 DESC, key LIMIT 40""")
def a17_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.Search(group_by="entity_id", must_include=("event_type", ("CALL", "IP_SESSION")), limit=40)
    return search.run(canonical_events(spark, sf_dir), s)


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT max(ts_start)::DATE AS d FROM ev WHERE event_type = 'TRANSACTION') SELECT event_id, event_type, ts_start FROM ev, a WHERE ts_start::DATE >= d - 3 AND ts_start::DATE < d ORDER BY ts_start DESC, event_id LIMIT 100""")
def w07_relative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.Search(window=search.Window("last", -3, 3, "TRANSACTION"), limit=100)
    return search.run(canonical_events(spark, sf_dir), s).select("event_id", "event_type", "ts_start")


# ---------------------------------------------------------------- messy sources


@query("SELECT url, title, links FROM (SELECT page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, len(regexp_extract_all(html, '<li>')) AS links FROM pages) x")
def s10_html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("url", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("(<li>)"), 1)).cast("long").alias("links"))


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS rows FROM pages WHERE len(regexp_extract_all(html, '<li>')) >= 2")
def s10_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.tables(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("rows"))


_GRID = "grid AS (SELECT doc_id AS file, (unnest(g)).r::INT AS row, (unnest(g)).c AS cells FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {'r': i - 1, 'c': string_split(x, ' ')}) AS g FROM documents WHERE text IS NOT NULL) x)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    return lines.select("file", "row", F.split("line", " ", -1).alias("cells"))


@query(f"""WITH {_GRID}, w AS (SELECT file, row, len(cells) AS width FROM grid), n AS (SELECT file, width, count(*) AS n FROM w GROUP BY 1, 2), c AS (SELECT file, max({{'n': n, 'w': width}}).w AS common FROM n GROUP BY 1),
    k AS (SELECT w.file, row, width, width IS DISTINCT FROM lag(width) OVER (PARTITION BY w.file ORDER BY row) AS new FROM w JOIN c ON c.file = w.file WHERE width >= 0.6 * common),
    r AS (SELECT *, sum(new::INT) OVER (PARTITION BY file ORDER BY row) AS run FROM k) SELECT file, run::BIGINT AS run, width, min(row) AS first_row, max(row) AS last_row, count(*) AS rows FROM r GROUP BY file, run, width""")
def g05_width_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.width_runs(_grid(spark, sf_dir))


# ---------------------------------------------------------------- scores, similarity and reports


@query()
def r13_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    f = features.entity_features(e, _transfers(spark, sf_dir), correlate.correlate(e, 60)).where("total_events > 0")
    return anomaly.isolation_scores(f, ["total_in", "total_out", "txn_count", "fan_in", "fan_out", "night_ratio", "inout_ratio", "strong", "medium", "max_calls_hour", "max_dormancy_days", "max_rapid_forward"])


@query()
def j14_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 pairs of part names that look most alike: a top-k report."""
    got = similar.similar_labels(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return got.orderBy(F.desc("similarity"), "a", "b").limit(50)


@query(f"""{_FLAGS_SQL}, el(rule, eligible) AS (SELECT 'rapid_in_out', count(*) FROM (SELECT entity_id FROM fl WHERE direction = 'CREDIT' GROUP BY 1 HAVING sum(amount) > 0) UNION ALL SELECT 'mule_account', count(*) FROM fi WHERE fan_in >= 5
    UNION ALL SELECT 'call_transfer_coincidence', count(*) FROM co UNION ALL SELECT 'comm_burst', count(*) FROM cb WHERE most > 0 UNION ALL SELECT 'dormant_activation', count(*) FROM (SELECT entity_id FROM ev WHERE event_type = 'TRANSACTION' AND entity_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'structuring', count(*) FROM (SELECT entity_id FROM fl WHERE direction = 'CREDIT' GROUP BY 1 HAVING sum(amount) >= 900000)), fd AS (SELECT rule, count(DISTINCT entity_id) AS fired FROM flags GROUP BY 1)
    SELECT rule, rule <> 'comm_burst' AS enabled, eligible, coalesce(fired, 0) AS fired, CASE WHEN rule = 'comm_burst' THEN 'disabled' WHEN eligible = 0 THEN 'no eligible entity' WHEN coalesce(fired, 0) = 0 THEN 'eligible but never fired' ELSE '' END AS note
    FROM el LEFT JOIN fd USING (rule)""")
def a20_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, flags = _flags(spark, sf_dir)
    tests = {"rapid_in_out": F.col("total_in") > 0, "mule_account": F.col("fan_in") >= 5, "call_transfer_coincidence": (F.col("strong") > 0) | (F.col("medium") > 0), "comm_burst": F.col("max_calls_hour") > 0, "dormant_activation": F.col("txn_count") > 1, "structuring": F.col("total_in") >= 900_000}
    return reports.eligibility(f, flags, tests, set(tests) - {"comm_burst"})


@query(f"WITH {EVENTS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY ts_start::DATE, ts_start, event_id) - 1 AS place, count(*) OVER () AS c FROM ev) SELECT event_id, ts_start FROM n WHERE place % ceil(c / 500)::BIGINT = 0")
def w08_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.downsample(canonical_events(spark, sf_dir), 500, ["ts_start", "event_id"]).select("event_id", "ts_start")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT entity_id, list_sort(list_distinct(list(cp::VARCHAR))) AS ids FROM ev WHERE event_type = 'CALL' AND cp IS NOT NULL GROUP BY 1)
    SELECT entity_id, array_to_string(ids[1:4], ', ') || CASE WHEN len(ids) > 4 THEN ' (+' || (len(ids) - 4) || ' more)' ELSE '' END AS subject FROM s""")
def p09_subject_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = canonical_events(spark, sf_dir).where("event_type = 'CALL' AND counterparty_entity_id IS NOT NULL")
    return c.groupBy("entity_id").agg(F.collect_set(F.col("counterparty_entity_id").cast("string")).alias("ids")).select("entity_id", reports.subject_line(F.col("ids")).alias("subject"))


@query("""SELECT event_type AS source_file, count(*) AS rows, count(*) FILTER (event_id % 3 = 0) AS rejected FROM events GROUP BY 1""")
def a13_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_file")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("event_id") % 3 == 0, 1)).alias("rejected"))
    return reports.reject_report(r)


@query(f"""WITH {EVENTS_SQL} SELECT entity_id, entity_id % 7 AS own, 'member' AS how FROM (SELECT DISTINCT entity_id FROM ev) x WHERE entity_id IN (SELECT cp FROM ev WHERE event_type = 'CALL')""")
def u06_ego_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that someone called: a semi join of a graph's nodes with its edges."""
    e = canonical_events(spark, sf_dir)
    called = e.where("event_type = 'CALL'").select(F.col("counterparty_entity_id").alias("entity_id"))
    return e.select("entity_id").distinct().join(called, "entity_id", "left_semi").select("entity_id", (F.col("entity_id") % 7).alias("own"), F.lit("member").alias("how"))
