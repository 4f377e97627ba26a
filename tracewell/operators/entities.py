"""Identifiers resolved into entities, and lookups against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.scalars import phone
from tracewell.operators.components import connected_components
from tracewell.scratch import table

#: Only these kinds of identifier merge entities; addresses, names and payment handles never do.
MERGE_KINDS = ("PHONE", "ACCOUNT_NO", "IMEI", "IMSI")


def identifier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): phones and devices seen together in any event."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("PHONE:"), F.col("user_id").cast("string")).alias("a"), F.concat(F.lit("IMEI:"), k, F.lit("-"), F.floor(F.col("user_id") / 10).cast("string")).alias("b"))


def resolve(edges: DataFrame, cap: int = 50) -> DataFrame:
    """(identifier, entity_id, size, oversized): components of merge identifiers; the entity is named by its smallest."""
    merge = edges.where(F.split("a", ":")[0].isin(*MERGE_KINDS) & F.split("b", ":")[0].isin(*MERGE_KINDS))
    c = connected_components(merge, "a", "b")
    size = c.groupBy("component").agg(F.count("*").alias("size"))
    return c.join(size, "component").select(F.col("node").alias("identifier"), F.col("component").alias("entity_id"), "size", (F.col("size") > cap).alias("oversized"))


def attached(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """(identifier, entity_id): identifiers that never merge entities, such as addresses, names and handles, with every
    entity that has one of its own beside them in a record. edges: a, b."""
    merges = lambda c: F.split(c, ":")[0].isin(*MERGE_KINDS)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weak = both.where(merges("a") & ~merges("b")).select(F.col("a").alias("identifier"), F.col("b").alias("weak")).distinct()
    return weak.join(resolved.select("identifier", "entity_id"), "identifier").select(F.col("weak").alias("identifier"), "entity_id").distinct()


def entity_labels(resolved: DataFrame, weak: DataFrame, holders: DataFrame) -> DataFrame:
    """(entity_id, label): the holder's name, that of the smallest identifier that has one, else the smallest phone, account,
    address or device. weak: attached(); holders: identifier, holder."""
    all_ids = resolved.select("identifier", "entity_id").unionByName(weak)
    named = all_ids.join(holders.where("trim(holder) <> ''"), "identifier", "left")
    kind, value = F.split("identifier", ":")[0], F.expr("substring_index(identifier, ':', -1)")
    least = [F.min(F.when(kind == k, value)) for k in ("PHONE", "ACCOUNT_NO", "IP", "IMEI")]
    name = F.min(F.when(F.col("holder").isNotNull(), F.struct("identifier", "holder")))["holder"]
    return named.groupBy("entity_id").agg(F.coalesce(name, *least).alias("label"))


def entity_rows(resolved: DataFrame) -> DataFrame:
    """(entity_id, identifiers, kinds, label, oversized): one row per entity; its label is its smallest phone, else account,
    else device."""
    kind = F.split("identifier", ":")[0]
    least = lambda k: F.min(F.when(kind == k, F.expr("substring_index(identifier, ':', -1)")))
    return resolved.groupBy("entity_id").agg(F.count("*").alias("identifiers"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.coalesce(least("PHONE"), least("ACCOUNT_NO"), least("IMEI")).alias("label"), F.max("oversized").alias("oversized"))


def fan_out_refusal(pairs: DataFrame, most: int = 4, batch: str | None = None) -> DataFrame:
    """pairs (account, phone), all of a batch or none: a batch in which any side has over `most` partners is refused. batch
    names the column that tells batches apart; without it all pairs are one."""
    by = [batch] if batch else []
    p = pairs.where("account IS NOT NULL AND phone IS NOT NULL").distinct()
    side = lambda c: p.groupBy(*by, c).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("m"))
    worst = side("account").unionByName(side("phone")).groupBy(*by).agg(F.coalesce(F.max("m"), F.lit(0)).alias("worst"))
    met = p.join(worst, batch) if batch else p.crossJoin(F.broadcast(worst))  # one row
    return met.where(F.col("worst") <= most).drop("worst")


# Columns of an analyst's map and the kind of identifier each holds.
MAP_COLUMNS = {"account_no": "ACCOUNT_NO", "phone": "PHONE", "wallet": "ACCOUNT_NO", "upi_id": "UPI_ID", "imei": "IMEI", "imsi": "IMSI"}


def map_links(cells: DataFrame) -> DataFrame:
    """(file, row, ids): links that an analyst has written down, ids an array<struct<id_type, id_value>> of two or more.

    cells: file, row, header, value of map files without their comment lines. A file with type_a, value_a, type_b and
    value_b gives pairs of any kinds, others a column for each kind. Phones are written in full.
    """
    c = cells.select("file", "row", F.lower(F.trim("header")).alias("h"), F.trim(F.coalesce("value", F.lit(""))).alias("v")).where("v <> ''")
    wide = c.groupBy("file", "row").pivot("h", ["type_a", "value_a", "type_b", "value_b", *MAP_COLUMNS]).agg(F.first("v"))

    def one(kind: Column, value: Column) -> Column:
        full = F.when(kind == "PHONE", F.coalesce(phone(value), value)).otherwise(value)
        return F.when(kind.isNotNull() & value.isNotNull(), F.struct(kind.alias("id_type"), full.alias("id_value")))

    generic = F.array_compact(F.array(*(one(F.upper(f"type_{x}"), F.col(f"value_{x}")) for x in "ab")))
    named = F.array_compact(F.array(*(one(F.lit(k), F.col(n)) for n, k in MAP_COLUMNS.items())))
    pairs = F.col("type_a").isNotNull() | F.col("type_b").isNotNull()
    return wide.select("file", "row", F.when(pairs, generic).otherwise(named).alias("ids")).where(F.size("ids") >= 2)


def link_edges(links: DataFrame) -> DataFrame:
    """(a, b) for resolve(): each identifier of a link with the first of it."""
    name = lambda i: F.concat(i["id_type"], F.lit(":"), i["id_value"])
    return links.select(name(F.col("ids")[0]).alias("a"), F.explode(F.slice("ids", 2, F.size("ids"))).alias("i")).select("a", name(F.col("i")).alias("b"))


def labelled(rows: DataFrame, entities: DataFrame, ids: dict[str, str]) -> DataFrame:
    """rows with the label of the entity in each of some columns: ids maps a column to that of its label. An entity without
    a label, or none of the table's, keeps its id as its label."""
    for col, out in ids.items():
        own = entities.select(F.col("entity_id").alias(col), F.col("label").alias(out))
        rows = rows.join(own, col, "left").withColumn(out, F.coalesce(out, F.col(col).cast("string")))
    return rows


def lookup(rows: DataFrame, identifier: str, resolved: DataFrame) -> DataFrame:
    """rows with the entity of an identifier; one that no entity holds becomes an entity of its own, marked external."""
    m = resolved.select(F.col("identifier").alias(identifier), F.col("entity_id").alias("_found"))
    out = rows.join(m, identifier, "left")
    return out.withColumn("entity", F.coalesce("_found", identifier)).withColumn("external", F.col("_found").isNull()).drop("_found")
