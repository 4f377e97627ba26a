"""Read models: eligibility, recall, rejects, document classes and report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligibility(features: DataFrame, flags: DataFrame, tests: dict[str, Column], enabled: set[str]) -> DataFrame:
    """(rule, enabled, eligible, fired, note): one row per rule. eligible counts the entities that a rule could judge."""
    counts = features.agg(*(F.count(F.when(c, 1)).alias(r) for r, c in tests.items()))
    long = counts.unpivot([], list(tests), "rule", "eligible") if len(tests) else counts
    fired = flags.groupBy("rule").agg(F.count_distinct("entity_id").alias("fired"))
    out = long.join(fired, "rule", "left").fillna(0, ["fired"]).withColumn("enabled", F.col("rule").isin(*enabled) if enabled else F.lit(False))
    note = F.when(~F.col("enabled"), "disabled").when(F.col("eligible") == 0, "no eligible entity").when(F.col("fired") == 0, "eligible but never fired").otherwise("")
    return out.select("rule", "enabled", "eligible", "fired", note.alias("note"))


def eligibility_rollup(report: DataFrame) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return report.agg(n(F.col("enabled")).alias("enabled"), n(~F.col("enabled")).alias("disabled"), n(F.col("fired") > 0).alias("fired"), n(F.col("enabled") & (F.col("fired") == 0)).alias("inert"))


def recall(scenarios: DataFrame, flags: DataFrame) -> DataFrame:
    """(type, scenarios, detected, recall): a scenario is detected if any participant carries the rule of its type."""
    hit = scenarios.select("scenario", "type", F.explode("participants").alias("entity_id")).join(flags.select("entity_id", F.col("rule").alias("type")), ["entity_id", "type"], "left_semi").select("scenario").distinct().withColumn("hit", F.lit(1))
    out = scenarios.join(hit, "scenario", "left").groupBy("type").agg(F.count("*").alias("scenarios"), F.count("hit").alias("detected"))
    return out.withColumn("recall", F.round(F.col("detected") / F.col("scenarios"), 4))


def reject_report(rejects: DataFrame, n: int = 100) -> DataFrame:
    """The n files with most rejected rows. A top-k report."""
    return rejects.orderBy(F.desc(F.coalesce("rejected", "rows")), "source_file").limit(n)


# Words that tell what kind of paper a document is.
CLASSES = {
    "affidavit": "(?i)એફીડેવીટ|એફિડેવિટ|affidavit",
    "chargesheet": "(?i)ચાર્જશીટ|charge.?sheet",
    "bail_application": "જામીન અરજી",
    "arrest_record": r"\bMCR\b|ધરપકડ|અટક",
    "panchnama": "પંચનામ",
    "bank_reply": "બેંક એકાઉન્ટ નંબર",
    "notice": "યાદી|નોટીસ",
    "statement": "જવાબ|નિવેદન",
}


#: Texts of which a paper must hold one to fit its class's pattern, looked for in small letters: a plain search, which spares
#: most texts the pattern. None has an i, whose small letter depends on the locale.
NEEDED = {
    "affidavit": ["એફીડેવીટ", "એફિડેવિટ", "aff"],
    "chargesheet": ["ચાર્જશીટ", "charge"],
    "bail_application": ["જામીન અરજી"],
    "arrest_record": ["mcr", "ધરપકડ", "અટક"],
    "panchnama": ["પંચનામ"],
    "bank_reply": ["બેંક એકાઉન્ટ નંબર"],
    "notice": ["યાદી", "નોટીસ"],
    "statement": ["જવાબ", "નિવેદન"],
}


def document_classes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with classes, an array: those whose pattern is found, or `unclassified`."""
    may = lambda k: reduce(lambda a, b: a | b, (F.contains("_low", F.lit(w)) for w in NEEDED[k]))
    fits = [F.when(may(k), F.when(F.col(text_col).rlike(p), F.lit(k))) for k, p in CLASSES.items()]
    found = docs.withColumn("_low", F.lower(text_col)).withColumn("classes", F.array_compact(F.array(*fits))).drop("_low")
    return found.withColumn("classes", F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.array(F.lit("unclassified"))))


def mention_facets(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """(documents, prose_only, kind, mentions): how many documents name an identifier of each kind, beside the number of all
    documents and of those that are prose alone. docs: prose_only, and an array of values for each of kinds."""
    n = docs.agg(F.count("*").alias("documents"), F.count(F.when(F.col("prose_only"), 1)).alias("prose_only"), *(F.count(F.when(F.size(k) > 0, 1)).alias(k) for k in kinds))
    return n.unpivot(["documents", "prose_only"], kinds, "kind", "mentions")


def file_counts(files: DataFrame, known: tuple[str, ...] = ("BANK", "CDR", "IPDR")) -> DataFrame:
    """(source, files): files by source, all other sources, and none, as other. files: source_type."""
    u = F.upper(F.coalesce("source_type", F.lit("UNKNOWN")))
    return files.groupBy(F.when(u.isin(*known), F.lower(u)).otherwise("other").alias("source")).agg(F.count("*").alias("files"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows in order, with the number of all rows beside each. order must tell all rows apart."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def enriched(scores: DataFrame, features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """scores with what a list of entities shows beside them: volume (all money in and out), txn_count and event_count (its
    transactions and coincidences), and the label where labels (entity_id, label) are given."""
    own = features.select("entity_id", F.coalesce("txn_count", F.lit(0)).alias("txn_count"), (F.coalesce("txn_count", F.lit(0)) + F.coalesce("strong", F.lit(0)) + F.coalesce("medium", F.lit(0))).alias("event_count"), F.round(F.coalesce("total_in", F.lit(0.0)) + F.coalesce("total_out", F.lit(0.0)), 2).alias("volume"))
    out = scores.join(own, "entity_id", "left").fillna(0, ["txn_count", "event_count", "volume"])
    return out.join(labels.select("entity_id", "label"), "entity_id", "left") if labels is not None else out


#: Grounds that a draft names before it counts the rest, and subjects it is written for (the reference's own limits).
GROUNDS, SUBJECTS = 4, 10


def draft_lines(ranked: DataFrame, flags: DataFrame, most: int = GROUNDS) -> DataFrame:
    """(entity_id, line): for entities of a high or medium band with a flag, what a report says of them: score, grounds by
    name, and what is recommended, which for a medium band is no more than review. ranked: entity_id, risk_score, band."""
    own = flags.groupBy("entity_id").agg(F.array_sort(F.collect_set("rule")).alias("r"))
    n = F.size("r")
    more = F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.when(n - most == 1, " further typology)").otherwise(" further typologies)"))).otherwise("")
    grounds = F.concat(F.array_join(F.transform(F.slice("r", 1, most), lambda x: F.replace(x, F.lit("_"), F.lit(" "))), "; "), more)
    action = F.when(F.col("band") == "high", "put forward for filing, subject to confirmation").otherwise("flagged for review")
    line = F.concat(F.lit("Subject "), F.col("entity_id").cast("string"), F.lit(" | Risk "), F.format_string("%.1f", "risk_score"), F.lit(" ("), F.col("band"), F.lit(") | Grounds: "), grounds, F.lit(" | "), action)
    return ranked.where("band IN ('high', 'medium')").join(own, "entity_id").select("entity_id", line.alias("line"))


def ingestion_metrics(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, profile, files, rows, manual): what was read, by source and profile, and how many files wait for an analyst;
    source and profile are null for files that none claims. sizes: file, rows."""
    g = found.join(sizes, "file", "left")
    return g.groupBy("source", "profile").agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.when(F.col("needs_manual_mapping"), 1)).alias("manual"))


def top_hits(hits: DataFrame, n: int) -> DataFrame:
    """The n coincidences of highest amount, then the earliest. A top-k report."""
    return hits.orderBy(F.desc("amount"), "txn_ts", "txn_id", "entity_id").limit(n)


def subject_line(ids: Column, most: int = 4) -> Column:
    """The first identifiers of a sorted array, and how many more there are."""
    n = F.size(ids)
    s = F.array_sort(ids)
    return F.concat(F.array_join(F.slice(s, 1, most), ", "), F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(""))


def downsample(events: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Every k-th event of a timeline of over `most`, in order; k is their number over `most`, rounded up. The feature
    is a drawing aid of `most` points; places are counted within days, so no one task sorts all events."""
    from pyspark.sql import Window

    day = F.to_date("ts_start")
    days = events.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    at = F.row_number().over(Window.partitionBy("_day").orderBy(*order)) - 1
    placed = events.withColumn("_day", day).withColumn("_at", at).join(F.broadcast(before), "_day")
    return placed.where((F.col("_before") + F.col("_at")) % F.ceil(F.col("_all") / most) == 0).drop("_day", "_at", "_before", "_all")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
