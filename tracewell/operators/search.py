"""Declarative searches over canonical events, compiled to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import phone_key

OPS = ("eq", "neq", "gt", "gte", "lt", "lte", "contains", "in", "between")
PHONES = {"counterparty", "phone"}
#: Groups named so hold no value.
BLANKS = ["", "-", "--", "n/a", "na", "null", "none", "nil", "0", "unknown"]


@dataclass(frozen=True)
class Test:
    """One predicate: a field or group metric, an operation, and its value or values."""

    name: str
    op: str
    value: Any = None
    values: tuple = ()


@dataclass(frozen=True)
class Window:
    """Days [start, start + span) where start is offset days from the first or last event (or TRANSACTION, or CALL)."""

    anchor: str
    offset_days: int = 0
    span_days: int = 1
    event_type: str | None = None


@dataclass(frozen=True)
class Search:
    filters: tuple[Test, ...] = ()
    window: Window | None = None
    group_by: str | None = None
    aggregate: str = "count"
    having: tuple[Test, ...] = ()
    must_include: tuple[str, tuple] | None = None
    descending: bool = True
    limit: int = 100
    tie: str = field(default="key")


#: What a reader may look for anywhere in an event, where its table has it.
HAYSTACK = ["event_type", "direction", "label", "narration", "location", "cell_id", "imei", "imsi", "public_ip", "counterparty", "source_file"]


def any_text(*columns: str) -> Column:
    """One text of all that is filled in the columns, parted by spaces."""
    return F.concat_ws(" ", *(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns))


def fields() -> dict[str, Column]:
    """The searchable fields of an event; others are refused."""
    t = F.col("ts_start")
    return {"event_type": F.col("event_type"), "timestamp": F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "hour_of_day": F.hour(t), "date": F.to_date(t).cast("string"), "amount": F.col("amount"), "direction": F.col("direction"), "duration": F.col("duration"), "entity_id": F.col("entity_id"), "counterparty": F.col("counterparty_entity_id"), "any_text": any_text("event_type", "direction", "entity_id", "counterparty_entity_id")}


#: Fields of events that not every table has, and their columns.
OPTIONAL = {"entity_label": "label", "phone": "phone", "location": "location", "cell_id": "cell_id", "imei": "imei", "imsi": "imsi", "ip": "public_ip", "narration": "narration", "asset": "asset", "ref_no": "ref_no", "source_file": "source_file", "balance": "balance"}


def fields_of(events: DataFrame) -> dict[str, Column]:
    """The searchable fields of these events; any_text then is all that a reader sees of them."""
    more = {n: F.col(c) for n, c in OPTIONAL.items() if c in events.columns}
    seen = [c for c in HAYSTACK if c in events.columns and c not in ("event_type", "direction")]
    t = F.col("ts_start")
    return fields() | more | {"minute_of_day": F.hour(t) * 60 + F.minute(t), "weekday": F.date_format(t, "EEEE"), "any_text": any_text("event_type", "direction", "entity_id", "counterparty_entity_id", *seen)}


def predicate(c: Column, t: Test, numeric: bool) -> Column:
    """A null never matches; equality is of lower-cased text; order is of numbers where both are, else of text."""
    if t.op not in OPS:
        raise ValueError(f"unknown operation {t.op}")
    s = F.lower(c.cast("string"))
    want = F.lit(str(t.value).lower())
    if t.op in ("eq", "neq", "contains") and t.name in PHONES:
        a, b = phone_key(c), phone_key(F.lit(str(t.value)))
        by_key = (a != b) if t.op == "neq" else (a == b)
        plain = {"eq": s == want, "neq": s != want, "contains": s.contains(want)}[t.op]
        return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), by_key).otherwise(plain), F.lit(False))
    if t.op == "in":
        out = s.isin(*(str(v).lower() for v in t.values))
    elif t.op == "between":
        lo, hi = t.values[0], t.values[-1]
        out = c.cast("double").between(float(lo), float(hi)) if numeric else c.cast("string").between(str(lo), str(hi))
    elif t.op in ("eq", "neq", "contains"):
        out = {"eq": s == want, "neq": s != want, "contains": s.contains(want)}[t.op]
    else:
        a, b = (c.cast("double"), F.lit(float(t.value))) if numeric else (c.cast("string"), F.lit(str(t.value)))
        out = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[t.op]
    return F.coalesce(out, F.lit(False))


_NUMERIC = {"hour_of_day", "minute_of_day", "balance", "amount", "duration", "entity_id", "counterparty", "count", "sum_amount", "avg_amount", "max_amount"}


def metrics() -> dict[str, Column]:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"count": F.count("*"), "sum_amount": F.round(zero(F.sum("amount")), 2), "avg_amount": F.round(zero(F.avg("amount")), 2), "max_amount": F.round(zero(F.max("amount")), 2), "first_seen": F.to_date(F.min("ts_start")).cast("string"), "last_seen": F.to_date(F.max("ts_start")).cast("string")}


def in_window(events: DataFrame, w: Window) -> DataFrame:
    """Events of the window's days; the anchor is sought among all events given, so apply this before other filters."""
    of = events.where(F.col("event_type") == w.event_type) if w.event_type else events
    anchor = of.agg(F.to_date((F.max if w.anchor == "last" else F.min)("ts_start")).alias("_anchor"))
    day = F.to_date("ts_start")
    met = events.crossJoin(F.broadcast(anchor))  # one row
    return met.where((day >= F.date_add("_anchor", w.offset_days)) & (day < F.date_add("_anchor", w.offset_days + w.span_days))).drop("_anchor")


def run(events: DataFrame, q: Search) -> DataFrame:
    """Rows of a search: events by time, or groups by their aggregate, at most `limit` of them as the search states."""
    if not 1 <= q.limit <= 2000:
        raise ValueError("limit must be 1 to 2000")
    known = fields_of(events)
    for name in [t.name for t in q.filters] + ([q.group_by] if q.group_by else []):
        if name not in known:
            raise ValueError(f"unknown field {name}")
    rows = in_window(events, q.window) if q.window else events
    if q.filters:
        rows = rows.where(reduce(lambda a, b: a & b, (predicate(known[t.name], t, t.name in _NUMERIC) for t in q.filters)))
    if not q.group_by:
        order = F.desc("ts_start") if q.descending else F.asc("ts_start")
        return rows.orderBy(order, "event_id").limit(q.limit)
    key = known[q.group_by].cast("string")
    rows = rows.withColumn("key", key).where(F.col("key").isNotNull() & ~F.lower(F.trim("key")).isin(*BLANKS))
    made = metrics()
    aggs = {q.aggregate, *(t.name for t in q.having)}
    cols = [made[a].alias(a) for a in sorted(aggs)] + [F.count("*").alias("events")]
    if q.must_include:
        name, values = q.must_include
        cols.append(F.collect_set(F.when(F.lower(known[name].cast("string")).isin(*(str(v).lower() for v in values)), F.lower(known[name].cast("string")))).alias("_has"))
    g = rows.groupBy("key").agg(*cols)
    if q.must_include:
        g = g.where(F.size("_has") == len(set(map(str, q.must_include[1]))))
    for t in q.having:
        g = g.where(predicate(F.col(t.name), t, t.name in _NUMERIC))
    order = F.desc(q.aggregate) if q.descending else F.asc(q.aggregate)
    return g.orderBy(order, "key").limit(q.limit).select("key", q.aggregate, *(["events"] if q.aggregate != "events" else []))


# ---------------------------------------------------------------- searches over entities and coincidences

#: Fields of an entity; the last five are lists, of which any element may match.
ENTITY_FIELDS = {"entity_id": "entity_id", "entity_label": "label", "risk_score": "risk_score", "risk_band": "band", "rule_flag": "flags", "phone": "phones", "account_no": "accounts", "imei": "imeis", "imsi": "imsis"}
LISTS = {"rule_flag", "phone", "account_no", "imei", "imsi"}
#: Fields of a coincidence; others never match.
HIT_FIELDS = {"entity_id": "entity_id", "entity_label": "label", "tier": "tier", "amount": "amount"}


def _holds(t: Test, column: str, numeric: bool) -> Column:
    if t.name in LISTS:
        return F.coalesce(F.exists(column, lambda x: predicate(x, t, False)), F.lit(False))
    return predicate(F.col(column), t, numeric)


def _searched(rows: DataFrame, q: Search, known: dict[str, str], order: list[Column], shape: list[Column]) -> DataFrame:
    if not 1 <= q.limit <= 2000:
        raise ValueError("limit must be 1 to 2000")
    if unknown := [t.name for t in q.filters if t.name not in known]:
        raise ValueError(f"unknown field {unknown[0]}")
    for t in q.filters:
        rows = rows.where(_holds(t, known[t.name], t.name in ("risk_score", "amount")))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(q.limit).select(*shape).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > q.limit)  # one row


def run_entities(entities: DataFrame, q: Search) -> DataFrame:
    """(entity, entity_id, risk, band, flags, total, truncated): entities that pass all filters, by risk, at most `limit`.

    entities: entity_id, label, risk_score, band, and the arrays flags, phones, accounts, imeis and imsis. total counts
    all that pass. A test on a list holds if it holds for any element; an empty or missing list never passes."""
    risk = F.coalesce("risk_score", F.lit(0.0))
    order = [F.desc(risk) if q.descending else F.asc(risk), F.col("entity_id")]
    shape = [F.col("label").alias("entity"), F.col("entity_id"), F.col("risk_score").alias("risk"), F.col("band"), F.array_join(F.array_sort(F.array_distinct("flags")), ", ").alias("flags")]
    return _searched(entities, q, ENTITY_FIELDS, order, shape)


def run_hits(hits: DataFrame, q: Search) -> DataFrame:
    """(entity, when, amount, why, total, truncated): strong coincidences that pass all filters, by time of the transfer;
    why is the first 120 signs of the explanation. hits: entity_id, label, tier, amount, txn_ts, txn_id, explanation."""
    when = F.desc("txn_ts") if q.descending else F.asc("txn_ts")
    shape = [F.col("label").alias("entity"), F.col("txn_ts").alias("when"), F.col("amount"), F.substring("explanation", 1, 120).alias("why")]
    return _searched(hits.where("tier = 'STRONG'"), q, HIT_FIELDS, [when, F.col("txn_id"), F.col("entity_id")], shape)


def shaped_events(events: DataFrame, labels: DataFrame) -> DataFrame:
    """(type, when, entity, amount, direction): what is shown of events; when is ISO text, entity the label of its owner."""
    own = labels.select("entity_id", F.col("label").alias("entity"))
    return events.join(own, "entity_id", "left").select(F.col("event_type").alias("type"), F.date_format("ts_start", "yyyy-MM-dd'T'HH:mm:ss").alias("when"), "entity", "amount", "direction")


#: Rows that a workbench shows at most (the reference's own limit).
SHOWN = 500


def workbench(rows: DataFrame, text: str, label: str = "label", attributes: str = "attributes", order: list | None = None, most: int = SHOWN) -> DataFrame:
    """rows whose label or any of whose attributes (a struct or map) hold a text, in whatever case, `most` of them at most."""
    want = F.lit(text.strip().lower())
    hay = F.concat_ws(" ", F.lower(F.col(label).cast("string")), F.lower(F.to_json(attributes)))
    return rows.where(F.contains(hay, want)).orderBy(*(order or rows.columns[:1])).limit(most)


def serialised(events: DataFrame) -> DataFrame:
    """(id, json): events as text for a reader: times in ISO form, the minute of the day, attributes without what is null."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    minute = F.hour("ts_start") * 60 + F.minute("ts_start")
    body = F.struct(F.col("event_type").alias("type"), iso("ts_start").alias("start"), iso("ts_end").alias("end"), minute.alias("minute_of_day"), F.col("entity_id").cast("string").alias("entity"), F.col("counterparty_entity_id").cast("string").alias("counterparty"), "amount", "direction")
    return events.select(F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("id"), F.to_json(body).alias("json"))
