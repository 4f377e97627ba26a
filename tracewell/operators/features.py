"""Sliding-window signals and features of entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.correlate import MINUTE
from tracewell.plans.adapter import micros


def max_in_window(events: DataFrame, minutes: int, key: str = "entity_id", ts: str = "ts_start") -> DataFrame:
    """(key, most): the most events of a key in a window of so many minutes, both ends counted."""
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-minutes * MINUTE, 0)
    return events.select(key, micros(F.col(ts)).alias("_t")).withColumn("n", F.count("*").over(w)).groupBy(key).agg(F.max("n").alias("most"))


def max_gap_days(events: DataFrame, key: str = "entity_id", ts: str = "ts_start") -> DataFrame:
    """(key, gap_days): the longest time between an event of a key and its next, 0 for one event."""
    w = Window.partitionBy(key).orderBy("_t")
    gap = (F.col("_t") - F.lag("_t").over(w)) / F.lit(86_400_000_000.0)
    return events.select(key, micros(F.col(ts)).alias("_t")).withColumn("g", gap).groupBy(key).agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("gap_days"))


def rapid_forward(flows: DataFrame, minutes: int) -> DataFrame:
    """(entity_id, forwarded): over an entity's credits, the largest share that same-asset debits sent on within so many
    minutes, at most 1, to three decimals. flows: entity_id, asset, direction, amount, ts_start."""
    w = Window.partitionBy("entity_id", "asset").orderBy("_t").rangeBetween(0, minutes * MINUTE)
    out = F.sum(F.when(F.col("direction") == "DEBIT", F.coalesce("amount", F.lit(0.0))).otherwise(0.0)).over(w)
    f = flows.select("entity_id", "asset", "direction", "amount", micros(F.col("ts_start")).alias("_t")).withColumn("out", out)
    share = F.least(F.lit(1.0), F.col("out") / F.col("amount"))
    credits = f.where("direction = 'CREDIT' AND amount > 0").groupBy("entity_id").agg(F.round(F.max(share), 3).alias("forwarded"))
    return credits


def flows_with_counterparties(txns: DataFrame, transfers: DataFrame) -> DataFrame:
    """Money in and out by entity: own transactions, and for entities with none those that transfers show of them."""
    own = txns.select("entity_id", "asset", "direction", "amount", "ts_start", F.lit(False).alias("from_transfers"))
    seen = txns.select("entity_id").distinct()
    t = transfers.where("amount IS NOT NULL AND ts IS NOT NULL AND from_entity <> to_entity")
    side = lambda who, d: t.select(F.col(who).alias("entity_id"), "asset", F.lit(d).alias("direction"), "amount", F.col("ts").alias("ts_start"), F.lit(True).alias("from_transfers"))
    more = side("from_entity", "DEBIT").unionByName(side("to_entity", "CREDIT")).join(seen, "entity_id", "left_anti")
    return own.unionByName(more)


def distinct_identifiers(events: DataFrame) -> DataFrame:
    """(entity_id, distinct_ips, distinct_devices): how many addresses and devices an entity's own records name as its own.
    events: entity_id, own_ids array<struct<id_type, id_value>>."""
    own = events.select("entity_id", F.explode("own_ids").alias("i")).select("entity_id", "i.id_type", "i.id_value").distinct()
    n = lambda k: F.count(F.when(F.col("id_type") == k, 1))
    return own.where("entity_id IS NOT NULL").groupBy("entity_id").agg(n("IP").alias("distinct_ips"), n("IMEI").alias("distinct_devices"))


def entity_features(events: DataFrame, transfers: DataFrame, hits: DataFrame, hold_minutes: int = 120) -> DataFrame:
    """One row per entity of the events, transfers or hits, with its totals, counts, ratios and window signals; where events
    have own_ids, its distinct addresses and devices too."""
    night = (F.hour("ts_start") <= 5) | (F.hour("ts_start") >= 23)
    base = events.groupBy("entity_id").agg(F.count("*").alias("total_events"), F.count(F.when(night, 1)).alias("night_events"), F.count(F.when(F.col("event_type") == "TRANSACTION", 1)).alias("txn_count"))
    txns = events.where("event_type = 'TRANSACTION'")
    flows = flows_with_counterparties(txns, transfers)
    money = flows.groupBy("entity_id").agg(F.sum(F.when(F.col("direction") == "CREDIT", F.coalesce("amount", F.lit(0.0))).otherwise(0.0)).alias("total_in"), F.sum(F.when(F.col("direction") == "DEBIT", F.coalesce("amount", F.lit(0.0))).otherwise(0.0)).alias("total_out"), F.max("from_transfers").alias("from_transfers_only"))
    fan_in = transfers.groupBy(F.col("to_entity").alias("entity_id")).agg(F.count_distinct("from_entity").alias("fan_in"))
    fan_out = transfers.groupBy(F.col("from_entity").alias("entity_id")).agg(F.count_distinct("to_entity").alias("fan_out"))
    tiers = hits.groupBy("entity_id").agg(F.count(F.when(F.col("tier") == "STRONG", 1)).alias("strong"), F.count(F.when(F.col("tier") == "MEDIUM", 1)).alias("medium"))
    calls = max_in_window(events.where("event_type = 'CALL'"), 60).withColumnRenamed("most", "max_calls_hour")
    parts = [base, money, fan_in, fan_out, tiers, calls, max_gap_days(txns).withColumnRenamed("gap_days", "max_dormancy_days"), rapid_forward(flows, hold_minutes).withColumnRenamed("forwarded", "max_rapid_forward")]
    if "own_ids" in events.columns:
        parts.append(distinct_identifiers(events))
    # Each part has an entity once, so one shuffle of their union brings them together.
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where("entity_id IS NOT NULL")
    f = both.groupBy("entity_id").agg(*(F.max(c).alias(c) for c in both.columns if c != "entity_id"))
    f = f.fillna(0, [c for c in f.columns if c not in ("entity_id", "from_transfers_only")]).fillna(False, ["from_transfers_only"])
    return f.withColumn("night_ratio", F.when(F.col("total_events") > 0, F.col("night_events") / F.col("total_events")).otherwise(0.0)).withColumn("inout_ratio", F.when(F.col("total_in") != 0, F.col("total_out") / F.col("total_in")).otherwise(0.0))
