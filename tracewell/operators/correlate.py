"""Calls, sessions and transfers that coincide in time, by participant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.adapter import micros

MINUTE = 60_000_000


def participants(events: DataFrame, event_type: str) -> DataFrame:
    """Events of a type, once for their entity and once more for another counterparty, as column eid."""
    who = F.array_distinct(F.array_compact(F.array("entity_id", "counterparty_entity_id")))
    return events.where(F.col("event_type") == event_type).withColumn("eid", F.explode(who))


def nearest_call(txns: DataFrame, calls: DataFrame, minutes: int) -> DataFrame:
    """txns (eid, event_id, t, ..) with the call of the same eid nearest in time, within so many minutes; of two equally
    near the earlier. Both sides are sorted by (eid, time), forth and back: no join, so a busy entity costs no pairs."""
    a = txns.withColumn("is_call", F.lit(0))
    b = calls.select("eid", F.col("t"), F.struct(F.col("t").alias("at"), F.col("event_id").alias("id"), F.col("ts_start").alias("ts"), F.col("other")).alias("call"), F.lit(1).alias("is_call"))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy("eid").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    # Backwards, so that this frame too grows row by row; one that ends unbounded is summed anew for every row.
    after = Window.partitionBy("eid").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    # Of calls at one time the first event counts on either side.
    first_at = Window.partitionBy("eid", "t").orderBy(F.col("call.id").asc_nulls_last())
    both = both.withColumn("here", F.when(F.row_number().over(first_at) == 1, F.col("call")))
    both = both.withColumn("prev", F.max("here").over(before)).withColumn("next", F.min("here").over(after))
    near = F.when((F.col("next").isNull()) | (F.col("t") - F.col("prev.at") <= F.col("next.at") - F.col("t")), F.col("prev")).otherwise(F.col("next"))
    out = both.where("is_call = 0").withColumn("call", near).drop("is_call", "here", "prev", "next")
    return out.where(F.abs(F.col("call.at") - F.col("t")) <= minutes * MINUTE)


def first_session(hits: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """hits with the earliest session (ties by event_id) of the entity that overlaps [t - W, t + W], or null. Sessions
    are dealt to the hour-or-window buckets that they may meet, so the join is on (eid, bucket)."""
    size = max(minutes, 60) * MINUTE
    w = minutes * MINUTE
    s = sessions.select("eid", F.struct(F.col("t").alias("start"), F.col("event_id").alias("id"), micros(F.coalesce("ts_end", "ts_start")).alias("end"), F.col("ts_start").alias("ts")).alias("session"))
    s = s.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("session.start") - w) / size), F.floor((F.col("session.end") + w) / size))))
    h = hits.withColumn("bucket", F.floor(F.col("t") / size))
    met = h.join(s, ["eid", "bucket"]).where((F.col("session.start") <= F.col("t") + w) & (F.col("session.end") >= F.col("t") - w))
    first = met.groupBy("eid", "event_id").agg(F.min("session").alias("session"))
    return hits.join(first, ["eid", "event_id"], "left")


def correlate(events: DataFrame, minutes: int = 10) -> DataFrame:
    """Hits of transactions and calls of one participant: STRONG with an overlapping session of its own, else MEDIUM."""
    e = events.withColumn("t", micros(F.col("ts_start")))
    txns = participants(e, "TRANSACTION").select("eid", "event_id", "t", F.col("ts_start").alias("txn_ts"), "amount", "direction", "ref_no")
    calls = participants(e, "CALL").select("eid", "event_id", "t", "ts_start", F.col("counterparty_entity_id").alias("other"))
    sessions = e.where("event_type = 'IP_SESSION'").select(F.col("entity_id").alias("eid"), "event_id", "t", "ts_start", "ts_end")
    out = first_session(nearest_call(txns, calls, minutes), sessions, minutes)
    tier = F.when(F.col("session").isNotNull(), "STRONG").otherwise("MEDIUM")
    return out.select(F.col("eid").alias("entity_id"), F.col("event_id").alias("txn_id"), "txn_ts", "amount", "direction", F.col("call.id").alias("call_id"), F.col("call.ts").alias("call_ts"), F.col("session.id").alias("session_id"), F.col("session.ts").alias("session_start"), tier.alias("tier"))


def explain(hits: DataFrame, minutes: int) -> DataFrame:
    """hits with a sentence on what coincided."""
    amount = F.format_string("%.2f", "amount")
    said = F.concat(F.lit("Transfer of "), amount, F.lit(" at "), F.date_format("txn_ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" coincided with a call at "), F.date_format("call_ts", "yyyy-MM-dd HH:mm:ss"))
    return hits.withColumn("explanation", F.concat(said, F.when(F.col("tier") == "STRONG", F.lit(f" while online (within {minutes} min)")).otherwise(F.lit(f" (within {minutes} min, no session)"))))
