"""Detection rules, the composite score and its reports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.features import max_in_window, rapid_forward


@dataclass(frozen=True)
class Thresholds:
    """Parameters of the rules, with their weights in the score."""

    report_limit: float = 1_000_000
    band: float = 0.10
    structuring_count: int = 3
    structuring_hours: int = 24
    rapid_minutes: int = 60
    rapid_share: float = 0.80
    mule_fan_in: int = 5
    mule_minutes: int = 120
    mule_share: float = 0.70
    calls_per_hour: int = 30
    dormant_days: float = 90
    floor: float = 10_000
    cycle_length: int = 6
    hops: int = 3
    span_hours: int = 48
    weights: dict[str, float] = field(default_factory=lambda: {"structuring": 0.20, "rapid_in_out": 0.20, "layering": 0.15, "circular_flow": 0.15, "mule_account": 0.15, "call_transfer_coincidence": 0.15, "comm_burst": 0.10, "dormant_activation": 0.10})
    medium_weight: float = 0.075


def _flag(df: DataFrame, rule: str, weight: Column | float, value: Column) -> DataFrame:
    return df.select("entity_id", F.lit(rule).alias("rule"), (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"), value.cast("double").alias("value"))


def structuring(credits: DataFrame, t: Thresholds) -> DataFrame:
    """Entities with enough INR credits just under the limit within the window."""
    near = credits.where((F.col("asset") == "INR") & (F.col("amount") >= t.report_limit * (1 - t.band)) & (F.col("amount") < t.report_limit) & (F.col("direction") == "CREDIT"))
    most = max_in_window(near, 60 * t.structuring_hours)
    return _flag(most.where(F.col("most") >= t.structuring_count), "structuring", t.weights["structuring"], F.col("most"))


def rapid_in_out(flows: DataFrame, t: Thresholds) -> DataFrame:
    f = rapid_forward(flows, t.rapid_minutes)
    return _flag(f.where(F.col("forwarded") >= t.rapid_share), "rapid_in_out", t.weights["rapid_in_out"], F.col("forwarded"))


def mule_account(flows: DataFrame, features: DataFrame, t: Thresholds) -> DataFrame:
    """The cheap half first: only entities with the fan-in are measured for forwarding."""
    wide = features.where(F.col("fan_in") >= t.mule_fan_in).select("entity_id")
    f = rapid_forward(flows.join(wide, "entity_id", "left_semi"), t.mule_minutes)
    return _flag(f.where(F.col("forwarded") >= t.mule_share), "mule_account", t.weights["mule_account"], F.col("forwarded"))


def coincidence(features: DataFrame, t: Thresholds) -> DataFrame:
    w = F.when(F.col("strong") > 0, t.weights["call_transfer_coincidence"]).otherwise(t.medium_weight)
    return _flag(features.where("strong > 0 OR medium > 0"), "call_transfer_coincidence", w, F.col("strong") + F.col("medium"))


def comm_burst(features: DataFrame, t: Thresholds) -> DataFrame:
    return _flag(features.where(F.col("max_calls_hour") >= t.calls_per_hour), "comm_burst", t.weights["comm_burst"], F.col("max_calls_hour"))


def dormant_activation(features: DataFrame, t: Thresholds) -> DataFrame:
    return _flag(features.where(F.col("max_dormancy_days") >= t.dormant_days), "dormant_activation", t.weights["dormant_activation"], F.col("max_dormancy_days"))


def member_flags(members: DataFrame, rule: str, t: Thresholds, value: str) -> DataFrame:
    """Flags of the structural rules from (entity_id, value)."""
    return _flag(members, rule, t.weights[rule], F.col(value))


def run_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def band(score: Column) -> Column:
    """Closed whole-number bands; a score between two bands, such as 39.5, falls in none and counts as low."""
    return F.when(score.between(70, 100), "high").when(score.between(40, 69), "medium").otherwise("low")


def score(entities: DataFrame, flags: DataFrame, ml: DataFrame | None = None, rules_weight: float = 0.7, ml_weight: float = 0.3) -> DataFrame:
    """(entity_id, risk_score, band, typologies_fired, raw_weight, saturated, ml_scored) of all entities with features or flags."""
    own = flags.groupBy("entity_id").agg(F.round(F.sum("weight"), 6).alias("raw_weight"), F.count("*").alias("typologies_fired"))
    all_ids = entities.select("entity_id").unionByName(flags.select("entity_id")).distinct()
    out = all_ids.join(own, "entity_id", "left").fillna(0, ["raw_weight", "typologies_fired"])
    out = out.join(ml, "entity_id", "left") if ml is not None else out.withColumn("ml_score", F.lit(None).cast("double"))
    total = F.round(100 * (rules_weight * F.least(F.lit(1.0), "raw_weight") + ml_weight * F.coalesce("ml_score", F.lit(0.0))), 1)
    out = out.withColumn("risk_score", total)
    return out.select("entity_id", "risk_score", band(F.col("risk_score")).alias("band"), "typologies_fired", "raw_weight", (F.col("raw_weight") > 1).alias("saturated"), F.col("ml_score").isNotNull().alias("ml_scored"))


def ranked(scores: DataFrame, n: int) -> DataFrame:
    """The n entities of highest score; then of most typologies, most weight, smallest id. A top-k report."""
    return scores.orderBy(F.desc("risk_score"), F.desc("typologies_fired"), F.desc("raw_weight"), "entity_id").limit(n)


def heat_map(flags: DataFrame, rules: list[str]) -> DataFrame:
    """One row per flagged entity, a column per rule: the rule's weight times 100, null where it didn't fire."""
    return flags.groupBy("entity_id").pivot("rule", rules).agg(F.round(F.max("weight") * 100, 2))


def rule_rollup(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule").agg(F.max("weight").alias("max_weight"), F.count_distinct("entity_id").alias("entities"), F.count("*").alias("evidence"))
