"""Steps that must grow no faster than their input, and rows that larger tables bring."""

import datetime as dt
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.test_fusion import EVENT, event
from tracewell import case_queries, queries
from tracewell.operators import anomaly, correlate, reports
from tracewell.scratch import dealt
from tracewell.sources import columns, delimited


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_nearest_calls_of_a_busy_entity(spark):
    """No frame is summed anew for every row, and each transaction has the call that a search of all of them finds."""
    rng = random.Random(5)
    rows = [event(i, rng.choice(["TRANSACTION", "CALL"]), rng.randrange(2000), amount=1.0) for i in range(1500)]
    hits = correlate.correlate(spark.createDataFrame(rows, EVENT), 10)
    assert "unboundedfollowing" not in plan(hits)
    calls = [(r[2], r[0]) for r in rows if r[1] == "CALL"]
    want = {}
    for r in rows:
        if r[1] == "TRANSACTION":
            t, i = min(calls, key=lambda c: (abs(c[0] - r[2]), *c))
            if abs(t - r[2]) <= dt.timedelta(minutes=10):
                want[r[0]] = i
    assert {h.txn_id: h.call_id for h in hits.collect()} == want


def test_orders_of_customer_zero_without_items(spark, tmp_path):
    """An order that no item answers goes to 0, whoever placed it."""
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    spark.range(2).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit(5.0).alias("o_totalprice"), t.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_suppkey"), F.col("id").alias("l_partkey"), F.lit(5.0).alias("l_extendedprice"), t.alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.j01_double_entry(spark, str(tmp_path)).collect()
    assert sorted((r.from_entity, r.to_entity, r.ref) for r in got) == [(0, 0, 0), (1, 0, 1)]


def test_words_that_hold_a_label_are_none(spark, tmp_path):
    """A card number after a word with IMEI in it is no handset; a branch is bounded by what is no ASCII word."""
    rows = [(0, "die Eimeinheit 4111 1111 1111 1111"), (1, "x"), (2, "\u00e4HDFC0123456"), (3, "IMEINo: 359788098237234")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.kind: r.mentions for r in case_queries.a25_mention_facets(spark, str(tmp_path)).collect()}
    assert got == {"accounts": 1, "branches": 2, "handsets": 2}


def test_tasks_of_files_hold_a_bounded_number_of_rows(spark):
    """A table ten times as large is dealt to ten times as many tasks, each file to one of them."""
    rows = spark.range(10_000).select((F.col("id") % 500).alias("file"), "id")
    met = dealt(rows, "file", most=500)
    assert met.rdd.getNumPartitions() == 20 and met.count() == 10_000
    assert met.select("file", F.spark_partition_id().alias("p")).distinct().count() == 500


def test_values_that_are_no_numbers_are_not_read_as_such(spark):
    """Reading a text as a number costs an exception where it is none, so only digits are read."""
    v = spark.createDataFrame([("443",), ("UPI/1/PAY/a@okbank",), ("70000",), ("9999999999999",)], "v string")
    k = columns.kinds(F.col("v"))
    got = v.select("v", *(k[n].alias(n) for n in ("port", "duration", "bytes")))
    read = re.findall(r"(THEN \()?try_cast\(v#\d+ as bigint\)", got._jdf.queryExecution().optimizedPlan().toString())
    assert read and all(read)
    assert [tuple(r)[1:] for r in got.collect()] == [(True, True, True), (False, False, False), (False, True, True), (False, False, False)]


def test_classes_are_found_once(spark, tmp_path):
    """Each pattern stands once in the plan, behind a plain search, and finds what it finds by itself."""
    texts = ["an AFFIDAVIT, charge\nsheet", "Charge-Sheet affable", "MCR", "xMCRx mcr", "નોટીસ ધરપકડ", None, "", "affıdavit"]
    spark.createDataFrame([(9 * i + 8, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = case_queries.f38_document_classes(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == len(reports.CLASSES)
    assert {r["class"]: r.documents for r in got.collect()} == {"affidavit": 1, "chargesheet": 1, "arrest_record": 2, "notice": 1, "unclassified": 4}


def test_lines_are_cut_once(spark):
    """The delimited lines of a file are cut by one projection, whose cells the later steps read."""
    lines = spark.createDataFrame([("f", 0, "date,memo"), ("f", 1, 'x,"a, ""b"""'), ("f", 2, "y,z")], "file string, row int, line string")
    got = delimited.cells(lines, ["date", "memo"])
    assert "split(" not in plan(got)
    assert sorted((r.row, r.header, r.value) for r in got.collect()) == [(0, "date", "x"), (0, "memo", 'a, "b"'), (1, "date", "y"), (1, "memo", "z")]


def test_values_next_to_each_other_are_parted():
    """Sums of the same amounts in another order may differ in their last bit; both sides of a cut then hold rows."""
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]] * 8)
    for seed in range(20):
        t = anomaly._tree(x, np.random.default_rng(seed))
        assert t[0][:2] == (0, x[1, 0]) and len(t) == 3
