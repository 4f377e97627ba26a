"""The fusion operators: registered queries against their SQL, and hand-made cases at the edges."""

import datetime as dt
import math
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell import case_queries, exhibit_queries, queries  # noqa: F401 all register
from tracewell.functions import scalars
from tracewell.operators import anomaly, components, correlate, entities, features, graph, ledger, reports, rules, search, transfers
from tracewell.sources import delimited, store
from tracewell.streaming import coincidences

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1, 12)


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(name, spark, duck):
    want = duck.sql(queries.ORACLE[name])
    cols = sorted(want.columns)
    rows = sorted(map(str, ([plain(r[c]) for c in cols] for r in queries.QUERIES[name](spark, SF).collect())))
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(map(str, ([plain(r[i]) for i in at] for r in want.fetchall())))


EVENT = "event_id long, event_type string, ts_start timestamp_ntz, ts_end timestamp_ntz, amount double, direction string, asset string, entity_id long, counterparty_entity_id long, ref_no long, duration long"


def event(i, kind, minute, entity=1, other=None, amount=None, direction=None, end=None, ref=None):
    t = T0 + dt.timedelta(minutes=minute)
    return (i, kind, t, T0 + dt.timedelta(minutes=end) if end is not None else t, amount, direction, "INR", entity, other, ref, None)


def test_tiers(spark):
    rows = [event(1, "TRANSACTION", 0, amount=5.0, direction="DEBIT"), event(2, "CALL", -10, 9, 1), event(3, "CALL", 10), event(4, "TRANSACTION", 100, amount=5.0), event(5, "CALL", 111), event(6, "TRANSACTION", 200), event(7, "CALL", 200), event(8, "IP_SESSION", 150, end=190), event(9, "IP_SESSION", 205, entity=2)]
    hits = {r.txn_id: r for r in correlate.correlate(spark.createDataFrame(rows, EVENT), 10).collect()}
    assert hits[1].call_id == 2 and hits[1].tier == "MEDIUM" and 4 not in hits
    assert hits[6].tier == "STRONG" and hits[6].session_id == 8


def test_transfers_by_reference(spark):
    rows = [event(1, "TRANSACTION", 0, 1, 7, 10.0, "DEBIT", ref=5), event(2, "TRANSACTION", 1, 2, 7, 11.0, "DEBIT", ref=5), event(3, "TRANSACTION", 2, 3, None, 11.0, "CREDIT", ref=5), event(4, "TRANSACTION", 3, 4, 6, 1.0, "DEBIT"), event(5, "TRANSACTION", 3, 4, 4, 1.0, "DEBIT"), event(6, "TRANSACTION", 3, 8, 9, 2.0, "DEBIT", ref=6), event(7, "TRANSACTION", 3, 8, None, 2.0, "CREDIT", ref=6)]
    got = {(r.from_entity, r.to_entity, r.amount) for r in transfers.build_transfers(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {(2, 3, 11.0), (4, 6, 1.0), (8, 9, 2.0)}


def test_window_edges(spark):
    rows = [event(i, "CALL", m) for i, m in enumerate((0, 30, 60, 61))]
    assert features.max_in_window(spark.createDataFrame(rows, EVENT), 60).first().most == 3
    flow = [event(1, "TRANSACTION", 0, amount=100.0, direction="CREDIT"), event(2, "TRANSACTION", 60, amount=79.96, direction="DEBIT"), event(3, "TRANSACTION", 61, amount=50.0, direction="DEBIT")]
    assert features.rapid_forward(spark.createDataFrame(flow, EVENT), 60).first().forwarded == 0.8


def test_cycles_and_chains(spark):
    e = spark.createDataFrame([(1, 2, 0), (2, 3, 10), (3, 1, 5), (3, 4, 1), (4, 5, 10**12)], "src long, dst long, t long")
    assert {r.entity_id: (r.cycles, r.shortest) for r in graph.circular_flow(e, 6).collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3)}
    assert {r.entity_id for r in graph.layering(e, 48).collect()} == {1, 2, 3, 4}


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (None, 3), (5, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 1000 for i in range(1000, 1100)) and len(got) == 141


def test_bands_and_score(spark):
    s = spark.createDataFrame([(39.0,), (39.5,), (40.0,), (69.5,), (70.0,)], "s double").select(rules.band(F.col("s")).alias("b"))
    assert [r.b for r in s.collect()] == ["low", "low", "medium", "low", "high"]
    flags = spark.createDataFrame([(1, "a", 0.6, 1.0), (1, "b", 0.6, 1.0), (2, "a", 0.1, 1.0)], "entity_id long, rule string, weight double, value double")
    got = {r.entity_id: r for r in rules.score(flags, flags).collect()}
    assert got[1].risk_score == 70.0 and got[1].saturated and got[2].risk_score == 7.0


def test_refusals(spark):
    ok = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3")], "account string, phone string")
    bad = ok.unionByName(spark.createDataFrame([("b", str(i)) for i in range(5)], "account string, phone string"))
    assert entities.fan_out_refusal(ok).count() == 2 and entities.fan_out_refusal(bad).count() == 0
    ip = spark.createDataFrame([("PHONE:1", "IP:9"), ("PHONE:2", "IP:9"), ("PHONE:1", "IMEI:5")], "a string, b string")
    assert {r.identifier for r in entities.resolve(ip).collect()} == {"PHONE:1", "IMEI:5"}


def test_scalars(spark):
    cases = [("+91 98765 43210", "+919876543210"), ("०९८७६५४३२१०", "+919876543210"), ("12345", None), ("447911123456", "+447911123456"), (None, None)]
    d = spark.createDataFrame([(a,) for a, _ in cases], "v string")
    assert [r.p for r in d.select(scalars.phone(F.col("v")).alias("p")).collect()] == [b for _, b in cases]
    money = [("Rs. 1,23,456.50/-", 123456.5), ("(12)", -12.0), (".", None), ("-5", -5.0), ("x", None), (None, None)]
    d = spark.createDataFrame([(a,) for a, _ in money], "v string")
    assert [r.p for r in d.select(scalars.amount(F.col("v")).alias("p")).collect()] == [b for _, b in money]
    times = [("11DEC2019:09:07:02", "2019-12-11 09:07:02"), ("05/01/2024", "2024-01-05 00:00:00"), ("09:07", None), ("2024-01-05T01:02:03", "2024-01-05 01:02:03"), ("junk", None)]
    d = spark.createDataFrame([(a,) for a, _ in times], "v string")
    assert [str(r.p) if r.p else None for r in d.select(scalars.timestamp(F.col("v")).alias("p")).collect()] == [b for _, b in times]
    v6 = [("2001:db8::1", "2001:db8:0:0::/64"), ("2001:0db8:0001:0002:0:0:0:1", "2001:db8:1:2::/64"), ("1.2.3.4", None)]
    d = spark.createDataFrame([(a,) for a, _ in v6], "v string")
    assert [r.p for r in d.select(scalars.ipv6_prefix(F.col("v")).alias("p")).collect()] == [b for _, b in v6]
    d = spark.createDataFrame([("ROAMING OUT",), ("Incoming",), ("x",)], "v string")
    assert [r.p for r in d.select(scalars.call_direction(F.col("v")).alias("p")).collect()] == ["OUT", "IN", "OUT"]


def test_balance_break(spark):
    rows = [("a", T0 + dt.timedelta(days=i), i, d, m, b) for i, (d, m, b) in enumerate([("CREDIT", 10.0, 10.0), ("DEBIT", 4.0, 6.0), ("DEBIT", 1.0, 9.0), ("CREDIT", 1.0, None)])]
    d = spark.createDataFrame(rows, "account string, ts timestamp_ntz, event_id long, direction string, amount double, balance double")
    assert tuple(ledger.balance_breaks(d).first()) == ("a", 2, 1, 0.5)


def test_search_semantics(spark):
    rows = [event(1, "CALL", 0, 9876543210, 5), event(2, "CALL", 1, None, 0), event(3, "TRANSACTION", 2, 3, 7, 100.0, "DEBIT")]
    e = spark.createDataFrame(rows, EVENT)
    one = lambda *t: sorted(r.event_id for r in search.run(e, search.Search(filters=t)).collect())
    assert one(search.Test("amount", "neq", "1")) == [3] and one(search.Test("amount", "eq", "100")) == []
    assert one(search.Test("hour_of_day", "between", values=(12, 13))) == [1, 2, 3]
    grouped = search.run(e, search.Search(group_by="counterparty")).collect()
    assert {r.key for r in grouped} == {"5", "7"}
    with pytest.raises(ValueError):
        search.run(e, search.Search(filters=(search.Test("nope", "eq", 1),)))


def test_delimited(spark, tmp_path):
    text = "Statement of account\nAccount Number;Date;Amount;;Amount\n1;05/01/2024;10;x;\n2;06/01/2024;;y;11\n"
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text(text)
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.csv").write_bytes('a,"b, ""c""",d\r\n\r\n1,2\r\n"x, y",3,4,5'.encode())
    found = delimited.files(spark, str(tmp_path))
    lines = delimited.lines_of(found.where("path LIKE '%.csv'")).withColumn("file", F.element_at(F.split("file", "/"), -1))
    assert {r.file: r.delimiter for r in delimited.delimiters(lines).collect()} == {"a.csv": ";", "b.csv": ";", "d.csv": ","}
    aliases = ["account number", "date", "amount"]
    rows = delimited.wide(delimited.cells(lines, aliases).where("file = 'a.csv'")).orderBy("row")
    assert rows.columns == ["file", "row", "Account Number", "Date", "Amount", "column_3", "Amount__2"]
    got = delimited.map_columns(rows, {"account": ["account  number"], "amount": ["Amount", "amount__2"], "none": ["x"]}).collect()
    assert [tuple(r) for r in got] == [("1", "10", None), ("2", "11", None)]
    assert {tuple(r.cells) for r in delimited.grid(lines).where("file = 'd.csv'").collect()} == {("a", 'b, "c"', "d"), ("1", "2"), ("x, y", "3", "4", "5")}
    odd = {r.row: r.reason for r in delimited.misfits(lines, aliases).where("file = 'd.csv'").collect()}
    assert odd == {2: "2 cells under a header of 3", 3: "4 cells under a header of 3"}
    assert delimited.cells(lines, aliases).where("file = 'd.csv' AND row = 0 AND col = 2").first().value == ""
    kept, over = delimited.cap_rows(rows.select("file", "row"), "file", "row", 1)
    assert kept.count() == 1 and [(r.rows, r.rejected) for r in over.collect()] == [(2, 1)]
    kept, copies = delimited.first_copies(found)
    assert kept.count() == 3 and copies.count() == 1 and delimited.unsupported(found).count() == 1
    kinds = {os.path.basename(r.path): r.k for r in found.select("path", delimited.container(F.col("content")).alias("k")).collect()}
    assert kinds["c.bin"] == "pdf" and kinds["a.csv"] == "text"


def test_store(spark, tmp_path):
    """Data sets replaced one by one, columns added later, counts read back."""
    path = str(tmp_path / "case")
    three, one = spark.range(3).toDF("x"), spark.range(1).toDF("x")
    store.save({"events": three, "entities": one}, path, "a")
    store.save({"events": spark.range(2).select(F.col("id").alias("x"), F.lit("new").alias("later"))}, path, "b")
    store.save({"events": one}, path, "a")
    assert {(r.dataset, r.x, r.later) for r in store.read(spark, path, "events").collect()} == {("a", 0, None), ("b", 0, "new"), ("b", 1, "new")}
    assert {r.table: r.rows for r in store.counts(spark, path, ["events", "entities", "hits"], "a").collect()} == {"events": 1, "entities": 1, "hits": 0}
    assert store.read(spark, path, "events", "b").count() == 2


def test_similar_labels_against_all_pairs(spark):
    """Labels meet under pieces; none is lost of the pairs that comparing all with all finds."""
    from difflib import SequenceMatcher

    from tracewell.operators import similar

    r = random.Random(2)
    names = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 22))).strip() for _ in range(60)]
    names += [n[:k] + r.choice("abx") + n[k + r.randint(0, 1) :] for n in names for k in [r.randrange(len(n) + 1)]] + [names[0], names[1].upper()]
    rows = [(i, n) for i, n in enumerate(names)] + [(999, None)]
    first = {}
    for i, n in rows:
        if n is not None and len(n.strip()) >= 4:
            first.setdefault(n.strip().lower(), i)
    want = set()
    for x, i in first.items():
        for y, j in first.items():
            if i < j and abs(len(x) - len(y)) <= 6 and round(SequenceMatcher(None, x, y).ratio(), 4) >= 0.88:
                want.add((i, j))
    got = {(p.a, p.b) for p in similar.similar_labels(spark.createDataFrame(rows, "id long, name string"), "id", "name").collect()}
    assert got == want and len(want) > 20


def test_profiles_and_flags(spark):
    headers = spark.createDataFrame([("t1", "Account  Number"), ("t1", "Date"), ("t1", "Debit"), ("t2", "IMEI")], "table string, header string")
    profiles = spark.createDataFrame([("bank", 0, "account", "account number"), ("bank", 0, "time", "date"), ("bank", 0, "debit", "debit"), ("cdr", 1, "device", "imei"), ("cdr", 1, "time", "date")], "profile string, place int, field string, alias string")
    assert {(r.table, r.profile, r.confidence) for r in delimited.profile_scores(headers, profiles).collect()} == {("t1", "bank", 1.0), ("t2", "cdr", 0.5)}
    grid = spark.createDataFrame([("123", "Yes", "no"), ("124", "", "1")], "number string, p1 string, p2 string")
    assert {tuple(r) for r in delimited.unpivot_flags(grid, "number").collect()} == {("123", "p1"), ("124", "p2")}


def test_streams(spark, tmp_path):
    rows = [event(1, "TRANSACTION", 0, amount=5.0), event(2, "CALL", 4), event(3, "CALL", 30), event(4, "CALL", 31)]
    d = spark.createDataFrame(rows, EVENT).withColumn("ts", F.col("ts_start").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    calls, txns = s.where("event_type = 'CALL'"), s.where("event_type = 'TRANSACTION'")
    for name, df, mode in (("pairs", coincidences.call_transfer_pairs(txns, calls), "append"), ("bursts", coincidences.call_bursts(calls, least=2), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r.txn_id, r.call_id) for r in spark.table("pairs").collect()] == [(1, 2)]
    assert {r.calls for r in spark.table("bursts").collect()} >= {2, 3}


def test_names_of_columns_are_plain():
    assert all(re.fullmatch(r"[a-z]\d\d_[a-z0-9_]+", n) for n in queries.QUERIES)


def test_dates_and_times_in_columns_of_their_own(spark):
    cases = [("05/01/2024", "10:20:30", "10:20:30"), ("20240105", "102030", "10:20:30"), ("2024-01-05", "91500", "09:15:00"), ("05-01-2024", "930", "09:30:00"), ("05-Jan-2024", "25:00", "00:00:00"), ("05/01/2024", None, "00:00:00"), ("'05/01/2024'", "'1230'", "12:30:00"), ("05/01/2024", "9:5", "09:05:00"), ("05/01/2024", "7", "00:00:00"), (None, "10:00", None), ("20241399", "10:00", None)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r.t for r in d.select("i", F.date_format(scalars.date_time(F.col("a"), F.col("b")), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i").collect()]
    assert got == [None if t is None else f"2024-01-05 {t}" for _, _, t in cases]
    utc = spark.createDataFrame([("05/01/2024", "20:00")], "a string, b string").select(scalars.date_time(F.col("a"), F.col("b"), "UTC").cast("string")).first()[0]
    assert utc == "2024-01-06 01:30:00"


def test_rows_with_split_times_are_events(spark):
    from tracewell.operators import normalise

    rows = spark.createDataFrame([("05/01/2024", "102030", "123456789", "5"), ("x", "1", "123456789", "5")], "date_col string, time_col string, account_no string, amount string")
    got = normalise.bank(rows).collect()
    assert str(got[0].ts_start) == "2024-01-05 10:20:30" and got[0].reason is None and got[1].reason == "no timestamp"


def test_links_labels_and_refusals(spark):
    cells = [("w", 0, "Account_No", "501"), ("w", 0, "phone", "98765 43210"), ("w", 0, "imei", " "), ("w", 1, "phone", "1"), ("g", 0, "type_a", "upi_id"), ("g", 0, "value_a", "a@b"), ("g", 0, "type_b", "Phone"), ("g", 0, "value_b", "12"), ("g", 1, "type_a", "phone"), ("g", 1, "value_a", "9876543210")]
    links = entities.map_links(spark.createDataFrame(cells, "file string, row int, header string, value string"))
    got = {(r.file, r.row): [tuple(i) for i in r.ids] for r in links.collect()}
    assert got == {("w", 0): [("ACCOUNT_NO", "501"), ("PHONE", "+919876543210")], ("g", 0): [("UPI_ID", "a@b"), ("PHONE", "12")]}
    assert {tuple(r) for r in entities.link_edges(links).collect()} == {("ACCOUNT_NO:501", "PHONE:+919876543210"), ("UPI_ID:a@b", "PHONE:12")}
    pairs = spark.createDataFrame([(1, "a", str(i)) for i in range(5)] + [(2, "a", str(i)) for i in range(4)] + [(2, "a", None)], "b int, account string, phone string")
    assert entities.fan_out_refusal(pairs, 4, "b").count() == 4 and entities.fan_out_refusal(pairs.drop("b")).count() == 0
    named = entities.labelled(spark.createDataFrame([(1, 2), (2, None), (3, 1)], "a long, b long"), spark.createDataFrame([(1, "x"), (2, None)], "entity_id long, label string"), {"a": "from", "b": "to"})
    assert {tuple(r)[-2:] for r in named.select("from", "to").collect()} == {("x", "2"), ("2", None), ("3", "x")}


def test_searches_over_lists(spark):
    none = []
    rows = [(1, "A", 80.0, "high", ["layering", "comm_burst"], ["+919876543210"], none, none, none), (2, "B", None, "low", none, none, none, none, none), (3, "C", 40.0, "medium", ["layering"], ["+911111111111", "+919876543210"], ["501"], none, none)]
    e = spark.createDataFrame(rows, "entity_id long, label string, risk_score double, band string, flags array<string>, phones array<string>, accounts array<string>, imeis array<string>, imsis array<string>")
    one = lambda *t, **k: [r.entity_id for r in search.run_entities(e, search.Search(filters=t, **k)).collect()]
    assert one(search.Test("phone", "eq", "98765 43210")) == [1, 3] and one(search.Test("phone", "neq", "9876543210")) == [3]
    assert one(search.Test("rule_flag", "in", values=("comm_burst", "x"))) == [1] and one(search.Test("account_no", "contains", "50")) == [3]
    assert one(search.Test("risk_score", "lt", 50)) == [3] and one(descending=False) == [2, 3, 1]
    cut = search.run_entities(e, search.Search(limit=1)).first()
    assert (cut.total, cut.truncated, cut.flags) == (3, True, "comm_burst, layering")
    with pytest.raises(ValueError):
        search.run_entities(e, search.Search(filters=(search.Test("amount", "eq", 1),)))
    h = spark.createDataFrame([(1, "A", "STRONG", 5.0, T0, 1, "x" * 200), (1, "A", "MEDIUM", 9.0, T0, 2, "y")], "entity_id long, label string, tier string, amount double, txn_ts timestamp_ntz, txn_id long, explanation string")
    got = search.run_hits(h, search.Search()).collect()
    assert len(got) == 1 and got[0].why == "x" * 120 and got[0].total == 1


def test_scores_with_the_forest(spark):
    """Seven tenths of the rules and three of the forest, by hand; entities the forest has not seen count as 0 there."""
    f = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), 1) for i in range(12)] + [(99, 0.0, 0.0, 0)], "entity_id long, a double, b double, total_events long")
    flags = spark.createDataFrame([(1, "x", 0.5, 1.0), (1, "y", 0.75, 1.0), (99, "x", 0.2, 1.0)], "entity_id long, rule string, weight double, value double")
    ml = anomaly.isolation_scores(f.where("total_events > 0"), ["a", "b"])
    own = {r.entity_id: r.ml_score for r in ml.collect()}
    assert len(own) == 12 and min(own.values()) == 0.0 and max(own.values()) == 1.0
    got = {r.entity_id: r for r in rules.score(f, flags, ml).collect()}
    raw = {1: 1.25, 99: 0.2}
    for i, r in got.items():
        want = round(100 * (0.7 * min(1.0, raw.get(i, 0.0)) + 0.3 * own.get(i, 0.0)) + 1e-9, 1)
        assert abs(r.risk_score - want) <= 0.1 and r.ml_scored == (i in own) and r.saturated == (raw.get(i, 0) > 1)
    assert anomaly.isolation_scores(f.limit(7), ["a", "b"]).count() == 0


def test_the_forest_finds_what_stands_apart(spark):
    r = random.Random(4)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)] + [(1000, 9.0, -9.0)]
    got = {x.entity_id: x.ml_score for x in anomaly.isolation_scores(spark.createDataFrame(rows, "entity_id long, a double, b double"), ["a", "b"]).collect()}
    assert got[1000] == max(got.values()) == 1.0 and sum(v > 0.8 for v in got.values()) < 15


def test_eligibility_and_recall(spark):
    f = spark.createDataFrame([(1, 5), (2, 0), (3, 7)], "entity_id long, x long")
    flags = spark.createDataFrame([(1, "a"), (3, "a"), (3, "a")], "entity_id long, rule string")
    tests = {"a": F.col("x") > 0, "b": F.col("x") > 100, "c": F.col("x") >= 0, "d": F.col("x") > 0}
    report = reports.eligibility(f, flags, tests, {"a", "b", "c"})
    assert {r.rule: (r.enabled, r.eligible, r.fired, r.note) for r in report.collect()} == {"a": (True, 2, 2, ""), "b": (True, 0, 0, "no eligible entity"), "c": (True, 3, 0, "eligible but never fired"), "d": (False, 2, 0, "disabled")}
    assert tuple(reports.eligibility_rollup(report).first()) == (3, 1, 1, 2)
    planned = spark.createDataFrame([(1, "a", [1, 9]), (2, "a", [2]), (3, "b", [3])], "scenario long, type string, participants array<long>")
    assert {r.type: (r.scenarios, r.detected, r.recall) for r in reports.recall(planned, flags).collect()} == {"a": (2, 1, 0.5), "b": (1, 0, 0.0)}


def test_structuring_needs_a_burst(spark):
    day = lambda i, h, a=9.5e5, asset="INR", d="CREDIT": (i, asset, d, a, T0 + dt.timedelta(hours=h))
    rows = [day(1, 0), day(1, 12), day(1, 24), day(2, 0), day(2, 25), day(2, 50), day(3, 0), day(3, 1), day(3, 2, 1e6), day(4, 0, asset="USD"), day(4, 1, asset="USD"), day(4, 2, asset="USD"), day(5, 0, d="DEBIT"), day(5, 1, d="DEBIT"), day(5, 2, d="DEBIT")]
    got = rules.structuring(spark.createDataFrame(rows, "entity_id long, asset string, direction string, amount double, ts_start timestamp_ntz"), rules.Thresholds()).collect()
    assert [(r.entity_id, r.value) for r in got] == [(1, 3.0)]


def test_labelled_mentions(spark):
    text = "A/C No.- 501002345678, account number: 123456789012; IFSC HDFC0001234 hdfc0001234 IMEI: 359788/09/777823/4 and IMSI 405870182224029, case 9999999999"
    m = scalars.labelled_mentions(F.col("t"))
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(*(c.alias(k) for k, c in m.items())).collect()
    assert got[0].accounts == ["123456789012", "501002345678"] and got[0].branches == ["HDFC0001234"]
    assert got[0].handsets == ["359788097778234"] and got[0].subscribers == ["405870182224029"] and got[2].accounts == []
    kinds = reports.document_classes(spark.createDataFrame([("an AFFIDAVIT and MCR",), ("x",), ("જામીન અરજી",)], "text string")).collect()
    assert [r.classes for r in kinds] == [["affidavit", "arrest_record"], ["unclassified"], ["bail_application"]]


def test_pages_and_counts(spark):
    d = spark.range(10).withColumnRenamed("id", "x")
    got = reports.page(d, ["x"], 8, 5).collect()
    assert [(r.x, r.total) for r in got] == [(8, 10), (9, 10)] and reports.page(d, ["x"], 20, 5).count() == 0
    files = spark.createDataFrame([("BANK",), ("cdr",), ("WEBMAIL",), (None,)], "source_type string")
    assert {r.source: r.files for r in reports.file_counts(files).collect()} == {"bank": 1, "cdr": 1, "other": 2}
