"""Balances, series, de-duplication and case summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signed(direction: Column, amount: Column) -> Column:
    return F.when(direction == "CREDIT", amount).otherwise(-amount)


def balance_breaks(rows: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(account, checked, breaks, consistency): rows whose balance isn't the one before plus the movement. rows: account,
    ts, event_id, direction, amount, balance."""
    before = F.lag("balance").over(Window.partitionBy("account").orderBy("ts", "event_id"))
    r = rows.where("balance IS NOT NULL AND amount IS NOT NULL").withColumn("prev", before).where("prev IS NOT NULL")
    broken = F.abs(F.col("prev") + signed(F.col("direction"), F.col("amount")) - F.col("balance")) > tolerance
    out = r.groupBy("account").agg(F.count("*").alias("checked"), F.count(F.when(broken, 1)).alias("breaks"))
    return out.withColumn("consistency", F.round(1 - F.col("breaks") / F.col("checked"), 4))


def daily_series(rows: DataFrame, days: int = 30, unit: float = 1e7) -> DataFrame:
    """(day, inflow, outflow) of the first `days` days, in crore; whatever isn't a credit flows out. A bounded report."""
    inn = F.col("direction").isin("CREDIT", "IN", "CR")
    s = rows.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum(F.when(inn, F.col("amount")).otherwise(0.0)) / unit, 4).alias("inflow"), F.round(F.sum(F.when(inn, 0.0).otherwise(F.col("amount"))) / unit, 4).alias("outflow"))
    return s.orderBy("day").limit(days)


def activity(events: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per day, a count per type of event."""
    return events.groupBy(F.to_date("ts_start").alias("day")).pivot("event_type", kinds).agg(F.count("event_id")).fillna(0)


#: What makes two events of a type the same.
SAME = {
    "TRANSACTION": ["entity_id", "counterparty_entity_id", "amount", "direction", "ref_no", "ts_start"],
    "CALL": ["entity_id", "counterparty_entity_id", "ts_start", "duration"],
    "IP_SESSION": ["entity_id", "ts_start", "ts_end", "public_ip", "private_ip", "port", "destination_ip"],
}


def dedupe(events: DataFrame, order: str = "event_id") -> DataFrame:
    """The first event of each key; the key depends on the type, nulls in it are equal to each other alone, and columns
    that events do not have are left out of it."""
    own = {k: [F.col(c).cast("string").alias(c) for c in cols if c in events.columns] for k, cols in SAME.items()}
    key = F.coalesce(*(F.when(F.col("event_type") == k, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})) for k, cols in own.items()))
    w = Window.partitionBy("event_type", key).orderBy(order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reject_split(events: DataFrame) -> DataFrame:
    """(event_type, reason, rows): why rows can't be events; rows without a fault have the reason `kept`."""
    reason = F.when(F.col("ts_start").isNull(), "no timestamp").when(F.col("entity_id").isNull() & F.col("counterparty_entity_id").isNull(), "timestamp but no identifier").otherwise("kept")
    return events.groupBy("event_type", reason.alias("reason")).agg(F.count("*").alias("rows"))
