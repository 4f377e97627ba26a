"""Directed transfers from double entries, and their amount floors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_transfers(txns: DataFrame) -> DataFrame:
    """(from_entity, to_entity, amount, asset, ts, ref): the last debit and the last credit under one reference, of
    different entities; and each debit under no such reference with another counterparty. txns needs event_id,
    entity_id, counterparty_entity_id, amount, direction, asset, ts_start, ref_no. A null reference matches nothing."""
    leg = txns.where("direction IN ('DEBIT', 'CREDIT') AND ref_no IS NOT NULL")
    last = lambda d: F.max_by(F.struct("entity_id", "amount", "asset", "ts_start"), F.when(F.col("direction") == d, F.col("event_id")))
    legs = leg.groupBy("ref_no").agg(last("DEBIT").alias("d"), last("CREDIT").alias("c"), F.count(F.when(F.col("direction") == "DEBIT", 1)).alias("nd"), F.count(F.when(F.col("direction") == "CREDIT", 1)).alias("nc"))
    met = legs.where("nd > 0 AND nc > 0 AND d.entity_id <> c.entity_id")
    matched = met.select(F.col("d.entity_id").alias("from_entity"), F.col("c.entity_id").alias("to_entity"), F.col("d.amount").alias("amount"), F.coalesce("d.asset", F.lit("INR")).alias("asset"), F.col("d.ts_start").alias("ts"), F.col("ref_no").alias("ref"))
    rest = txns.where("direction = 'DEBIT' AND entity_id <> counterparty_entity_id").join(met.select("ref_no"), "ref_no", "left_anti")
    fallback = rest.select(F.col("entity_id").alias("from_entity"), F.col("counterparty_entity_id").alias("to_entity"), "amount", F.coalesce("asset", F.lit("INR")).alias("asset"), F.col("ts_start").alias("ts"), F.col("ref_no").alias("ref"))
    return matched.unionByName(fallback)


def upper_median(transfers: DataFrame) -> DataFrame:
    """(n, median): the INR amount at place floor(n / 2) of the sorted amounts, found by counts of distinct amounts."""
    amounts = transfers.where("asset = 'INR' AND amount IS NOT NULL").groupBy("amount").agg(F.count("*").alias("k"))
    total = amounts.agg(F.sum("k").alias("n"))
    # A running count over ranges of amounts, so that no single task sorts them all.
    bucket = F.floor(F.log2(F.greatest(F.abs("amount"), F.lit(1e-9))) * 64) * F.signum("amount")
    b = amounts.withColumn("b", bucket)
    sums = b.groupBy("b").agg(F.sum("k").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = F.sum("k").over(Window.partitionBy("b").orderBy("amount").rowsBetween(Window.unboundedPreceding, 0))
    placed = b.withColumn("upto", upto).join(F.broadcast(sums.select("b", "before")), "b").crossJoin(F.broadcast(total))
    at = F.floor(F.col("n") / 2)
    return placed.where((F.col("before") + F.col("upto") > at) & (F.col("before") + F.col("upto") - F.col("k") <= at)).select("n", F.col("amount").alias("median"))


def over_floor(transfers: DataFrame, floor: float) -> DataFrame:
    """Transfers that count for structure: other assets and unknown amounts, and INR amounts of the floor or more."""
    return transfers.where((F.col("asset") != "INR") | F.col("amount").isNull() | (F.col("amount") >= floor)) if floor else transfers


def over_adaptive_floor(transfers: DataFrame, configured: float) -> DataFrame:
    """over_floor with the smaller of the configured floor and the transfers' own upper median; no INR amounts leave
    the configured floor, and a floor of zero lets all through. The floor stays in the plan, as one broadcast row."""
    if not configured:
        return transfers
    low = F.least(F.lit(float(configured)), F.coalesce(F.min("median"), F.lit(float(configured))))
    floor = upper_median(transfers).agg(low.alias("_floor"))
    kept = (F.col("asset") != "INR") | F.col("amount").isNull() | (F.col("amount") >= F.col("_floor"))
    return transfers.crossJoin(F.broadcast(floor)).where(kept).drop("_floor")
