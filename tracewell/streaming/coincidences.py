"""Coincidences of calls and transfers on streams, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_transfer_pairs(txns: DataFrame, calls: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Pairs of a transfer and a call of one entity within so many minutes. Both streams have entity_id, event_id, ts
    (timestamp); watermarks let the join drop what can't meet any more."""
    t = txns.withWatermark("ts", late).select(F.col("entity_id"), F.col("event_id").alias("txn_id"), F.col("ts").alias("txn_ts"), "amount")
    c = calls.withWatermark("ts", late).select(F.col("entity_id").alias("_entity"), F.col("event_id").alias("call_id"), F.col("ts").alias("call_ts"))
    near = F.expr(f"entity_id = _entity AND call_ts BETWEEN txn_ts - INTERVAL {minutes} MINUTES AND txn_ts + INTERVAL {minutes} MINUTES")
    return t.join(c, near).drop("_entity")


def call_bursts(calls: DataFrame, window: str = "60 minutes", slide: str = "10 minutes", least: int = 30, late: str = "1 hour") -> DataFrame:
    """(entity_id, start, calls): sliding windows with a burst of calls."""
    n = calls.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "entity_id").agg(F.count("*").alias("calls"))
    return n.where(F.col("calls") >= least).select("entity_id", F.col("w.start").alias("start"), "calls")
