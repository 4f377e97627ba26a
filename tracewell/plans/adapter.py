"""The driver's tables as canonical events, transfers and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.scratch import table


def micros(ts: Column) -> Column:
    """Microseconds of a zone-free timestamp, for range frames and differences."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, ts_start, ts_end, amount, direction, asset, entity_id, counterparty_entity_id, ref_no, duration)."""
    kind, k = F.col("event_type"), F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    e = table(spark, sf_dir, "events").where(kind != "error").withColumn("k", k)
    end = F.when(kind == "view", F.col("ts") + F.make_dt_interval(mins="k")).when(kind == "click", F.col("ts") + F.make_dt_interval(secs="k")).otherwise(F.col("ts"))
    money = kind.isin("purchase", "signup")
    return e.select(
        "event_id",
        F.when(money, "TRANSACTION").when(kind == "click", "CALL").otherwise("IP_SESSION").alias("event_type"),
        F.col("ts").alias("ts_start"),
        end.alias("ts_end"),
        F.when(money, F.col("value")).alias("amount"),
        F.when(kind == "purchase", "DEBIT").when(kind == "signup", "CREDIT").alias("direction"),
        F.when(money, "INR").alias("asset"),
        F.col("user_id").alias("entity_id"),
        F.when(kind != "view", F.col("k").cast("long")).alias("counterparty_entity_id"),
        F.when(money, F.col("event_id")).alias("ref_no"),
        F.when(kind == "click", F.col("k").cast("long")).alias("duration"),
    )


#: The same projection in SQL, as the common table ev.
EVENTS_SQL = """ev AS (
    SELECT event_id, CASE WHEN et IN ('purchase', 'signup') THEN 'TRANSACTION' WHEN et = 'click' THEN 'CALL' ELSE 'IP_SESSION' END AS event_type,
           ts AS ts_start, CASE et WHEN 'view' THEN ts + to_minutes(k) WHEN 'click' THEN ts + to_seconds(k) ELSE ts END AS ts_end,
           CASE WHEN et IN ('purchase', 'signup') THEN value END AS amount,
           CASE et WHEN 'purchase' THEN 'DEBIT' WHEN 'signup' THEN 'CREDIT' END AS direction,
           CASE WHEN et IN ('purchase', 'signup') THEN 'INR' END AS asset, user_id AS entity_id,
           CASE WHEN et <> 'view' THEN k::BIGINT END AS cp, CASE WHEN et IN ('purchase', 'signup') THEN event_id END AS ref_no,
           CASE WHEN et = 'click' THEN k::BIGINT END AS duration
    FROM (SELECT event_id, ts, user_id, event_type AS et, value, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events WHERE event_type <> 'error') x)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as account movements: (event_id, account, ts, amount, direction)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderstatus") == "F", "CREDIT").otherwise("DEBIT").alias("direction"))
