"""Registered queries of a case's own tables: times, features, links, labels, searches, pages; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import scalars
from tracewell.operators import anomaly, correlate, entities, features, ledger, normalise, reports, rules, search
from tracewell.plans import exhibits
from tracewell.plans.adapter import EVENTS_SQL, canonical_events
from tracewell.queries import _FLAGS_SQL, _IDS, _flags, _hits_sql, _transfers, query
from tracewell.scratch import table, written
from tracewell.sources import columns, delimited, grids, regions

# ---------------------------------------------------------------- times


@query("""SELECT event_id, CASE event_id % 6 WHEN 4 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ts FROM events""")
def f08_date_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and times in columns of their own, in six forms; a time that is none is midnight."""
    k = F.col("event_id") % 6
    date = F.date_format("ts", "dd/MM/yyyy")
    date = F.when(k == 1, F.date_format("ts", "yyyyMMdd")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(date)
    time = F.when(k.isin(0, 5), F.date_format("ts", "HH:mm:ss")).when(k == 3, F.regexp_replace(F.date_format("ts", "HHmm"), "^0", "")).when(k == 4, "none").otherwise(F.regexp_replace(F.date_format("ts", "HHmmss"), "^0", ""))
    # Runs of zeros at the front of a short time are written in full: nothing tells 0000 from 00.
    time = F.when(k.isin(1, 2) & F.date_format("ts", "HHmmss").rlike("^00"), F.date_format("ts", "HH:mm:ss")).when((k == 3) & F.date_format("ts", "HHmm").rlike("^00"), F.date_format("ts", "HH:mm")).otherwise(time)
    return table(spark, sf_dir, "events").select("event_id", scalars.date_time(date, time).alias("ts"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE date_trunc('second', ts) END AS ts FROM events""")
def f15_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filled of three ways to say when; one that can't be read is not passed over."""
    k, full, none = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(None).cast("string")
    start = F.when(k == 1, full).when(k == 0, "not read").when(k == 3, "no time at all")
    at = scalars.event_time(F.when(k == 0, full).otherwise(F.lit(" ")), start, F.when(k >= 2, F.date_format("ts", "dd-MM-yyyy")), F.when(k == 2, F.date_format("ts", "HH:mm:ss")).otherwise(none))
    return table(spark, sf_dir, "events").select("event_id", at.alias("ts"))


# ---------------------------------------------------------------- features and scores


def _own_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with what each names as its own: a session's address, a call's device."""
    e = canonical_events(spark, sf_dir)
    props = table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("id_type"), value.alias("id_value"))
    ids = F.when(F.col("event_type") == "IP_SESSION", F.array(pair("IP", F.concat(F.lit("10.0.0."), "k")))).when(F.col("event_type") == "CALL", F.array(pair("IMEI", F.concat(F.lit("35"), F.col("k"))), pair("PHONE", F.col("entity_id").cast("string")))).otherwise(F.array().cast("array<struct<id_type:string,id_value:string>>"))
    return e.join(props, "event_id").withColumn("own_ids", ids).drop("k")


@query("""SELECT user_id AS entity_id, count(DISTINCT k) FILTER (event_type = 'view') AS distinct_ips, count(DISTINCT k) FILTER (event_type = 'click') AS distinct_devices
    FROM (SELECT user_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) x WHERE event_type IN ('view', 'click') GROUP BY 1""")
def a03_distinct_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.distinct_identifiers(_own_ids(spark, sf_dir))


#: What the forest looks at.
ML_FEATURES = ["total_in", "total_out", "txn_count", "fan_in", "fan_out", "distinct_ips", "distinct_devices", "night_ratio", "inout_ratio", "strong", "max_calls_hour", "max_dormancy_days", "max_rapid_forward"]


@query()
def r14_scores_with_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tenths rules, three tenths the forest, fitted on entities with events of their own; a test puts them together
    by hand. The forest's numbers are no SQL."""
    e = _own_ids(spark, sf_dir)
    f = written(features.entity_features(e, _transfers(spark, sf_dir), correlate.correlate(e.drop("own_ids"), 60)), "features")
    ml = anomaly.isolation_scores(f.where("total_events > 0"), ML_FEATURES)
    return rules.score(f, _flags(spark, sf_dir)[1], ml)


_STRUCT = rules.Thresholds(report_limit=50_000, band=0.5, structuring_count=3, structuring_hours=24)


@query("""SELECT entity_id, most FROM (SELECT l_suppkey AS entity_id, max(n) AS most FROM (SELECT l_suppkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n
    FROM lineitem WHERE l_extendedprice >= 25000 AND l_extendedprice < 50000 AND l_returnflag <> 'R') x GROUP BY 1) y WHERE most >= 3""")
def r04_structuring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits just under a limit, three within a day: line items as what their suppliers are paid, returns as debits."""
    credits = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.lit("INR").alias("asset"), F.when(F.col("l_returnflag") == "R", "DEBIT").otherwise("CREDIT").alias("direction"), F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("ts_start"))
    return rules.structuring(credits, _STRUCT).select("entity_id", F.col("value").cast("long").alias("most"))


@query("""SELECT event_type, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'no timestamp' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'timestamp but no identifier' ELSE 'kept' END AS reason, count(*) AS rows FROM events GROUP BY 1, 2""")
def f24_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that can't be events: a third of the errors have no time, a third nobody they are of."""
    bad = lambda k: (F.col("event_type") == "error") & (F.col("event_id") % 3 == k)
    e = table(spark, sf_dir, "events").select("event_type", F.when(~bad(0), F.col("ts")).alias("ts_start"), F.when(~bad(1), F.col("user_id")).alias("entity_id"), F.lit(None).cast("long").alias("counterparty_entity_id"))
    return ledger.reject_split(e)


# ---------------------------------------------------------------- links and labels


@query("""WITH p AS (SELECT DISTINCT o_custkey // 3 AS batch, o_custkey AS account, o_orderkey % 7 AS phone FROM orders), w AS (SELECT batch, max(n) AS m FROM (SELECT batch, count(*) AS n FROM p GROUP BY batch, account UNION ALL SELECT batch, count(*) FROM p GROUP BY batch, phone) GROUP BY batch)
    SELECT batch, account, phone FROM p JOIN w USING (batch) WHERE m <= 4""")
def j12_fan_out_refusal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in batches of three accounts: a batch in which an account or phone has over four partners is refused whole."""
    p = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 3).alias("batch"), F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 7).alias("phone"))
    return entities.fan_out_refusal(p, 4, "batch")


_MAP = "m AS (SELECT c_custkey AS row, c_custkey % 2 AS file, '50' || lpad(c_custkey::VARCHAR, 9, '0') AS acc, '98' || lpad(c_custkey::VARCHAR, 8, '0') AS ph, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey || '@okbank' END AS upi FROM customer)"


def _map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as two maps: one with a column for each kind, one of pairs of any kinds; every fifth row lacks its phone."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    account, phone = F.concat(F.lit("50"), F.lpad(k.cast("string"), 9, "0")), F.when(k % 5 > 0, F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0")))
    upi = F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"), F.lit("@okbank")))
    cell = lambda h, v: F.struct(F.lit(h).alias("header"), v.alias("value"))
    wide = F.array(cell("Account_No", account), cell("phone", phone), cell("UPI_ID", upi))
    pair = F.array(cell("type_a", F.lit("account_no")), cell("value_a", account), cell("type_b", F.lit("phone")), cell("value_b", phone))
    return c.select((k % 2).alias("file"), k.alias("row"), F.inline(F.when(k % 2 == 0, wide).otherwise(pair)))


@query(f"""WITH {_MAP}, i AS (SELECT file, row, list_filter(['ACCOUNT_NO:' || acc, CASE WHEN row % 5 > 0 THEN 'PHONE:+91' || ph END, CASE WHEN file = 0 THEN 'UPI_ID:' || upi END], lambda x: x IS NOT NULL) AS ids FROM m)
    SELECT file, row, array_to_string(ids, ',') AS ids FROM i WHERE len(ids) >= 2""")
def j08_map_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = entities.map_links(_map_cells(spark, sf_dir))
    return links.select("file", "row", F.array_join(F.transform("ids", lambda i: F.concat(i["id_type"], F.lit(":"), i["id_value"])), ",").alias("ids"))


@query("SELECT o_orderkey, coalesce(c_name, o_custkey::VARCHAR) AS owner FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 > 0")
def j16_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the name of their customer; a quarter of the customers have none, and keep their number."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).alias("label"))
    return entities.labelled(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, {"o_custkey": "owner"}).select("o_orderkey", "owner")


# ---------------------------------------------------------------- documents and files


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 9 WHEN 0 THEN ' Affidavit' WHEN 1 THEN ' charge-sheet' WHEN 2 THEN ' જામીન અરજી' WHEN 3 THEN ' MCR' WHEN 4 THEN ' પંચનામું' WHEN 5 THEN ' બેંક એકાઉન્ટ નંબર' WHEN 6 THEN ' નોટીસ' WHEN 7 THEN ' નિવેદન યાદી' ELSE '' END AS text FROM documents),
    k AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)એફીડેવીટ|એફિડેવિટ|affidavit') THEN 'affidavit' END, CASE WHEN regexp_matches(text, '(?i)ચાર્જશીટ|charge.?sheet') THEN 'chargesheet' END,
        CASE WHEN contains(text, 'જામીન અરજી') THEN 'bail_application' END, CASE WHEN regexp_matches(text, '\bMCR\b|ધરપકડ|અટક') THEN 'arrest_record' END, CASE WHEN contains(text, 'પંચનામ') THEN 'panchnama' END,
        CASE WHEN contains(text, 'બેંક એકાઉન્ટ નંબર') THEN 'bank_reply' END, CASE WHEN regexp_matches(text, 'યાદી|નોટીસ') THEN 'notice' END, CASE WHEN regexp_matches(text, 'જવાબ|નિવેદન') THEN 'statement' END], lambda x: x IS NOT NULL) AS k FROM d)
    SELECT class, count(*) AS documents FROM (SELECT unnest(CASE WHEN len(k) = 0 THEN ['unclassified'] ELSE k END) AS class FROM k) x GROUP BY class""")
def f38_document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of paper documents are: their texts, each with the words that such papers bear."""
    said = ["Affidavit", "charge-sheet", "જામીન અરજી", "MCR", "પંચનામું", "બેંક એકાઉન્ટ નંબર", "નોટીસ", "નિવેદન યાદી"]
    more = F.coalesce(*(F.when(F.col("doc_id") % 9 == i, F.lit(f" {w}")) for i, w in enumerate(said)), F.lit(""))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    # No document is without a class; a plain explode would make sure of that first, by finding all of them again.
    return reports.document_classes(d).select(F.explode_outer("classes").alias("class")).groupBy("class").agg(F.count("*").alias("documents"))


_PAPERS = r"""pp AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' A/C No. : ' || (100000000 + doc_id) || ' ' WHEN 1 THEN ' HDFC0' || lpad(doc_id::VARCHAR, 6, '0') || ' ' WHEN 2 THEN ' IMEI: 359788/09/' || lpad(doc_id::VARCHAR, 6, '0') || '/4. ' ELSE '' END AS text, doc_id % 3 = 0 AS prose_only FROM documents)"""


@query(_PAPERS.join(["WITH ", r""", f AS (SELECT doc_id, prose_only, regexp_matches(text, '(?i)(?:A/?C(?:\s*No)?|ACCOUNT\s*(?:NO|NUMBER)?)[\s.:#–-]*([0-9]{9,18})') AS a, regexp_matches(text, '\b([A-Z]{4}0[A-Z0-9]{6})\b') AS b, doc_id % 4 = 2 AS h FROM pp),
    n AS (SELECT count(*) AS documents, count(*) FILTER (prose_only) AS prose_only, count(*) FILTER (a) AS accounts, count(*) FILTER (b) AS branches, count(*) FILTER (h) AS handsets FROM f)
    SELECT documents, prose_only, 'accounts' AS kind, accounts AS mentions FROM n UNION ALL SELECT documents, prose_only, 'branches', branches FROM n UNION ALL SELECT documents, prose_only, 'handsets', handsets FROM n"""]))
def a25_mention_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents name an account, a branch or a handset beside its label."""
    k, id_ = F.col("doc_id") % 4, F.col("doc_id")
    said = F.when(k == 0, F.concat(F.lit(" A/C No. : "), (id_ + 100_000_000).cast("string"), F.lit(" "))).when(k == 1, F.concat(F.lit(" HDFC0"), F.lpad(id_.cast("string"), 6, "0"), F.lit(" "))).when(k == 2, F.concat(F.lit(" IMEI: 359788/09/"), F.lpad(id_.cast("string"), 6, "0"), F.lit("/4. "))).otherwise("")
    d = table(spark, sf_dir, "documents").select((id_ % 3 == 0).alias("prose_only"), F.concat(F.coalesce("text", F.lit("")), said).alias("text"))
    m = scalars.labelled_mentions(F.col("text"))
    return reports.mention_facets(d.select("prose_only", *(m[x].alias(x) for x in ("accounts", "branches", "handsets"))), ["accounts", "branches", "handsets"])


@query("""SELECT source, count(*) AS files FROM (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'click' THEN 'cdr' ELSE 'other' END AS source FROM events WHERE event_type <> 'error' AND event_type IN ('click', 'view', 'signup')
    UNION ALL SELECT DISTINCT user_id, event_type, 'bank' FROM events WHERE event_type = 'purchase') x GROUP BY source""")
def a14_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the source that their headers tell."""
    found = columns.detected(exhibits.exhibits(spark, sf_dir), columns.profile_table(spark, exhibits.PROFILES), by_value=False)
    return reports.file_counts(found.select(F.col("source").alias("source_type")))


@query("""WITH l AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, strftime(o_orderdate, '%d-%m-%Y') AS d, 'to "A, B" ' || o_orderkey AS memo, printf('%.2f', round(o_totalprice, 2)) AS amount FROM orders)
    SELECT file, n - 1 AS row, (unnest([{'h': 'Txn Date', 'v': d}, {'h': 'Narration', 'v': memo}, {'h': 'Debit', 'v': amount}])).h AS header, (unnest([{'h': 'Txn Date', 'v': d}, {'h': 'Narration', 'v': memo}, {'h': 'Debit', 'v': amount}])).v AS value FROM l""")
def s01_delimited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files with different delimiters, quoted cells and lines above their header, all read in one plan."""
    return delimited.cells(exhibits.delimited_lines(spark, sf_dir), [a for p in exhibits.PROFILES for names in p["fields"].values() for a in (n.lower() for n in names)]).select("file", F.col("row").cast("long").alias("row"), "header", "value")


@query("""WITH g AS (SELECT o_custkey % 20 AS file, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS row, o_orderkey % 50 IN (0, 25) AS head, o_orderkey % 50 AS k FROM orders), h AS (SELECT *, CASE WHEN k = 0 THEN 'a' ELSE 'b' END AS name, lag(k) OVER (PARTITION BY file ORDER BY row) AS before FROM g WHERE head),
    n AS (SELECT file, row, (before IS NULL OR before <> k)::INT AS new FROM h), s AS (SELECT g.file, g.row, least(coalesce(sum(new) OVER (PARTITION BY g.file ORDER BY g.row), 0), 40) AS section FROM g LEFT JOIN n ON n.file = g.file AND n.row = g.row)
    SELECT file, section::BIGINT AS section, count(*) AS rows FROM s GROUP BY 1, 2""")
def g03_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables stacked in one grid, told apart by their headers; a header again goes on with its table."""
    from pyspark.sql import Window

    own = Window.partitionBy("file").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("file"), "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey") % 50
    text = lambda *cs: F.array(*map(F.lit, cs))
    cells = F.when(k == 0, text("Txn Date", "Debit", "Balance")).when(k == 25, text("Call Date", "Duration", "IMEI")).otherwise(F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.lit("x")))
    grid = o.select("file", (F.row_number().over(own) - 1).alias("row"), cells.alias("cells"))
    words = [a.lower() for p in exhibits.PROFILES for names in p["fields"].values() for a in names]
    return grids.sections(grid, words).groupBy("file", "section").agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- searches over entities and coincidences, pages


def _entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored entities with their flags and, as their phones and devices, what their calls name."""
    f, flags = _flags(spark, sf_dir)
    scored = rules.score(f, flags)
    own = flags.groupBy("entity_id").agg(F.collect_set("rule").alias("flags"))
    calls = canonical_events(spark, sf_dir).where("event_type = 'CALL'").groupBy("entity_id").agg(F.collect_set(F.concat(F.lit("+91987"), F.lpad(F.col("counterparty_entity_id").cast("string"), 7, "0"))).alias("phones"))
    none = F.array().cast("array<string>")
    rows = scored.join(own, "entity_id", "left").join(calls, "entity_id", "left").withColumn("label", F.concat(F.lit("Person "), F.col("entity_id").cast("string")))
    return rows.withColumns({"flags": F.coalesce("flags", none), "phones": F.coalesce("phones", none), "accounts": F.array(F.concat(F.lit("501"), F.col("entity_id").cast("string"))), "imeis": none, "imsis": none})


_PEOPLE = f"""{_FLAGS_SQL}, own_flags AS (SELECT entity_id, list_sort(list_distinct(list(rule))) AS fs FROM flags GROUP BY 1), ph AS (SELECT entity_id, list_distinct(list('987' || lpad(cp::VARCHAR, 7, '0'))) AS ps FROM ev WHERE event_type = 'CALL' GROUP BY 1),
    pe AS (SELECT b.*, coalesce(fs, []) AS fs, coalesce(ps, []) AS ps FROM banded b LEFT JOIN own_flags USING (entity_id) LEFT JOIN ph USING (entity_id))"""


@query(f"""{_PEOPLE}, hit AS (SELECT *, count(*) OVER () AS total FROM pe WHERE list_contains(fs, 'layering') AND risk_score >= 10 AND list_contains(ps, '9870000042'))
    SELECT 'Person ' || entity_id AS entity, entity_id, risk_score AS risk, band, array_to_string(fs, ', ') AS flags, total, total > 25 AS truncated FROM hit ORDER BY risk_score DESC, entity_id LIMIT 25""")
def q05_search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by a flag, a score and a phone, in whatever form the number is asked for."""
    q = search.Search(filters=(search.Test("rule_flag", "eq", "layering"), search.Test("risk_score", "gte", 10), search.Test("phone", "eq", "98700 00042")), limit=25)
    return search.run_entities(_entity_rows(spark, sf_dir), q)


@query(f"""WITH {_hits_sql(60)}, x AS (SELECT *, 'Person ' || entity_id AS label FROM hits WHERE tier = 'STRONG' AND amount >= 40 AND 'Person ' || entity_id LIKE '%1%'), n AS (SELECT count(*) AS total FROM x)
    SELECT label AS entity, txn_ts AS "when", amount, substr('Transfer of ' || printf('%.2f', amount) || ' at ' || strftime(txn_ts, '%Y-%m-%d %H:%M:%S') || ' coincided with a call at ' || strftime(call_ts, '%Y-%m-%d %H:%M:%S') || ' while online (within 60 min)', 1, 120) AS why,
    total, total > 30 AS truncated FROM x, n ORDER BY txn_ts DESC, txn_id, entity_id LIMIT 30""")
def q06_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong coincidences by amount and the name of whose they are."""
    h = correlate.explain(correlate.correlate(canonical_events(spark, sf_dir), 60), 60).withColumn("label", F.concat(F.lit("Person "), F.col("entity_id").cast("string")))
    return search.run_hits(h, search.Search(filters=(search.Test("amount", "gte", 40), search.Test("entity_label", "contains", "1")), limit=30))


@query(f"""WITH {EVENTS_SQL} SELECT event_type AS type, strftime(ts_start, '%Y-%m-%dT%H:%M:%S') AS "when", CASE WHEN entity_id % 2 = 0 THEN 'Person ' || entity_id END AS entity, amount, direction FROM ev""")
def q08_shaped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = canonical_events(spark, sf_dir)
    labels = e.where("entity_id % 2 = 0").select("entity_id").distinct().withColumn("label", F.concat(F.lit("Person "), F.col("entity_id").cast("string")))
    return search.shaped_events(e, labels)


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE contains(lower(concat_ws(' ', event_type, direction, entity_id::VARCHAR, cp::VARCHAR)), 'debit 7')")
def f35_any_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have a text anywhere among what a reader sees of them."""
    e = canonical_events(spark, sf_dir)
    return e.where(search.predicate(search.fields()["any_text"], search.Test("any_text", "contains", "DEBIT 7"), False)).select("event_id")


@query(f"WITH {EVENTS_SQL}, n AS (SELECT count(*) AS total FROM ev) SELECT event_id, ts_start, total FROM ev, n ORDER BY ts_start, event_id LIMIT 50 OFFSET 100")
def l04_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty events, and how many there are."""
    return reports.page(canonical_events(spark, sf_dir), ["ts_start", "event_id"], 100, 50).select("event_id", "ts_start", "total")


@query(f"WITH {_hits_sql(60)} SELECT txn_id, entity_id, amount FROM hits ORDER BY amount DESC, txn_ts, txn_id, entity_id LIMIT 12")
def l06_top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_hits(correlate.correlate(canonical_events(spark, sf_dir), 60), 12).select("txn_id", "entity_id", "amount")


@query("""WITH b AS (SELECT o_custkey AS file, count(*) AS n FROM orders GROUP BY 1) SELECT file, 'Customer ' || file AS account_holder, '501' || lpad(file::VARCHAR, 11, '0') AS account_no, n AS records FROM b""")
def s11_identified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with whose they are beside them, from the cover of their workbook."""
    books = written(exhibits.workbooks(spark, sf_dir), "books")
    data = books.where("sheet = 1").select("file", "row", "cells")
    words = [a.lower() for p in exhibits.PROFILES for names in p["fields"].values() for a in names]
    cells, _ = regions.grid_records(data, regions.header_rows(data, words))
    whose = regions.identities(books.where("sheet = 0").select("file", "row", "cells"))
    return regions.identified(cells, whose, ["account_holder", "account_no"]).groupBy("file", "account_holder", "account_no").agg(F.count_distinct("row").alias("records"))


# ---------------------------------------------------------------- rows of each kind of source as events


@query("""SELECT o_orderkey AS ref_no, o_orderdate AS ts_start, round(o_totalprice, 2) AS amount, CASE WHEN o_orderkey % 3 = 2 AND o_orderstatus <> 'F' THEN 'DEBIT' WHEN o_orderkey % 3 = 2 THEN 'CREDIT' WHEN o_orderkey % 3 = 0 THEN 'DEBIT' ELSE 'CREDIT' END AS direction,
    'ACCOUNT_NO:501' || lpad(o_custkey::VARCHAR, 9, '0') AS own, CASE o_orderkey % 4 WHEN 0 THEN 'PHONE:+9198' || lpad(o_orderkey::VARCHAR, 8, '0') WHEN 1 THEN 'ACCOUNT_NO:1' || lpad(o_orderkey::VARCHAR, 11, '0') WHEN 2 THEN 'UPI_ID:shop.' || o_custkey || '@okbank' ELSE 'BENEFICIARY:Anna Maria Smith' END AS other,
    CASE o_orderkey % 4 WHEN 3 THEN 'NEFT' ELSE 'UPI' END AS mode FROM orders""")
def f20_bank_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement rows as transactions: amounts in debit, credit or signed columns, the other side from the narration."""
    k, id_ = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    sum_ = F.format_number(F.round("o_totalprice", 2), 2)
    said = F.when(k % 4 == 0, F.concat(F.lit("UPI/98"), F.lpad(id_, 8, "0"), F.lit("@okbank/x"))).when(k % 4 == 1, F.concat(F.lit("UPI/1"), F.lpad(id_, 11, "0"), F.lit("@sbi/x"))).when(k % 4 == 2, F.concat(F.lit("UPI/shop."), F.col("o_custkey").cast("string"), F.lit("@okbank/x"))).otherwise("NEFT/Anna Maria Smith/ab")
    rows = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("when"), F.concat(F.lit("-:501"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("account_no"), said.alias("narration"),
        F.when(k % 3 == 0, sum_).alias("debit"), F.when(k % 3 == 1, sum_).alias("credit"), F.when(k % 3 == 2, F.when(F.col("o_orderstatus") == "F", sum_).otherwise(F.concat(F.lit("-"), sum_))).alias("amount"), id_.alias("ref_no"),
    )
    name = lambda c: F.concat(F.col(f"{c}.id_type"), F.lit(":"), F.col(f"{c}.id_value"))
    return normalise.bank(rows).select(F.col("ref_no").cast("long").alias("ref_no"), "ts_start", "amount", "direction", name("primary_id").alias("own"), name("counterparty_id").alias("other"), "mode")


@query("""SELECT event_id, date_trunc('second', ts) AS ts_start, k AS duration, CASE event_id % 3 WHEN 0 THEN 'OUT' ELSE 'IN' END AS direction, '+9198' || lpad(user_id::VARCHAR, 8, '0') AS phone, '+9197' || lpad(k::VARCHAR, 8, '0') AS other, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS own_ids
    FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events WHERE event_type = 'click') x""")
def f21_call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records as calls; a device is the caller's own only where the report is about the caller."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1))
    a = F.concat(F.lit("98"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    kind = F.when(F.col("event_id") % 3 == 0, "MOC").when(F.col("event_id") % 3 == 1, "SMS-T").otherwise("Roaming In")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), a.alias("a_party"), F.concat(F.col("k"), F.lit(".0")).alias("duration"), kind.alias("call_type"), F.concat(F.lit("35"), F.lpad("k", 13, "0")).alias("imei"), F.when(F.col("event_id") % 2 == 0, a).otherwise("9000000000").alias("target"), F.concat(F.lit("x_"), F.col("event_id").cast("string"), F.lit(".csv")).alias("source_file"), F.concat(F.lit("97"), F.lpad("k", 8, "0")).alias("b_party"))
    kept = written(normalise.calls(rows), "calls")
    return kept.select("ts_start", "duration", "direction", F.col("primary_id.id_value").alias("phone"), F.col("counterparty_id.id_value").alias("other"), F.size("own_ids").alias("own_ids")).join(_ids_of_calls(spark, sf_dir), ["ts_start", "phone", "other", "duration"]).select("event_id", "ts_start", "duration", "direction", "phone", "other", "own_ids")


def _ids_of_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts_start, phone, other, duration) of the events that the call records stand for."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("duration", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    return e.select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts_start"), F.concat(F.lit("+9198"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("phone"), F.concat(F.lit("+9197"), F.lpad(F.col("duration").cast("string"), 8, "0")).alias("other"), "duration")


def _session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as session records: a third name their subscriber, the others share an address block with one that does."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    u = F.col("user_id")
    v6 = F.concat(F.lit("2401:4900:"), F.lower(F.hex(F.floor(u / 10))), F.lit(":0:0:0:0:"), F.lower(F.hex(F.col("event_id") % 65536)))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("98"), F.lpad(u.cast("string"), 8, "0"))).alias("subscriber"), v6.alias("public_ip"))


@query("""WITH v AS (SELECT event_id, date_trunc('second', ts) AS ts, user_id // 10 AS block, CASE WHEN event_id % 3 = 0 THEN '+9198' || lpad(user_id::VARCHAR, 8, '0') END AS phone FROM events WHERE event_type = 'view'),
    f AS (SELECT block, phone FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ts, phone) AS n FROM v WHERE phone IS NOT NULL) x WHERE n = 1)
    SELECT coalesce(v.phone, f.phone) AS phone, v.phone IS NULL AND f.phone IS NOT NULL AS upgraded, count(*) AS sessions FROM v LEFT JOIN f USING (block) GROUP BY 1, 2""")
def j13_prefix_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a subscriber take that of the first session in the same block of addresses."""
    s = normalise.prefix_phones(normalise.sessions(_session_rows(spark, sf_dir)))
    return s.groupBy("phone", "upgraded").agg(F.count("*").alias("sessions"))


@query("""SELECT CASE WHEN event_id % 3 = 0 THEN 'PHONE' ELSE 'IP' END AS kind, count(*) AS sessions, count(DISTINCT CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR ELSE (user_id // 10) || ':' || event_id % 65536 END) AS ids, min(date_trunc('second', ts)) AS first FROM events WHERE event_type = 'view' GROUP BY 1""")
def f22_session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session records as sessions of a phone, else of an address."""
    s = normalise.sessions(_session_rows(spark, sf_dir))
    return s.groupBy(F.col("primary_id.id_type").alias("kind")).agg(F.count("*").alias("sessions"), F.count_distinct("primary_id.id_value").alias("ids"), F.min("ts_start").alias("first"))


@query("""SELECT CASE WHEN event_id % 5 = 0 THEN 'timestamp but no identifier' END AS reason, CASE WHEN event_id % 2 = 0 THEN 'CRYPTO:USDT' ELSE 'CRYPTO:CRYPTO' END AS asset, count(*) AS rows, sum(CASE WHEN event_id % 2 = 0 THEN CAST(round(value, 2) AS DECIMAL(18, 2)) * 83 END)::DOUBLE AS value_inr, min(date_trunc('second', ts)) + to_minutes(330) AS first
    FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
def f23_crypto_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows in UTC as debits, valued where their token has a rate; rows with one end only are no transfers."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("from_addr"), F.when(F.col("event_id") % 5 > 0, "Tx").alias("to_addr"), F.format_string("%.2f", F.round("value", 2)).alias("amount"), F.when(F.col("event_id") % 2 == 0, "USDT").alias("token"), F.col("event_id").cast("string").alias("txn_hash"))
    rates = spark.createDataFrame([("USDT", 83.0)], "token string, inr double")
    return normalise.crypto(rows, rates).groupBy("reason", "asset").agg(F.count("*").alias("rows"), F.sum(F.col("value_inr").cast("decimal(18,2)")).cast("double").alias("value_inr"), F.min("ts_start").alias("first"))


@query("""SELECT DISTINCT '50' || lpad(c_custkey::VARCHAR, 9, '0') AS account, '+91' || ph AS phone FROM (SELECT c_custkey, unnest(['98' || lpad(c_custkey::VARCHAR, 8, '0'), '70' || lpad((c_custkey // 7)::VARCHAR, 8, '0')]) AS ph FROM customer) x""")
def j11_reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts and mobiles from a bank's reply, whose cells hold several of them between other words."""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("A/C 50"), F.lpad(c.cast("string"), 9, "0"), F.lit(" (savings)")).alias("account"), F.concat(F.lit("+9198"), F.lpad(c.cast("string"), 8, "0"), F.lit(" / 070"), F.lpad(F.floor(c / 7).cast("string"), 8, "0"), F.lit(" mob")).alias("mobile"))
    return normalise.reply_pairs(rows, "account", "mobile")


@query("""SELECT lpad(c_custkey::VARCHAR, 7, '0') || '_sess_jan' AS col, '98' || lpad(c_custkey::VARCHAR, 8, '0') AS phone FROM customer""")
def j10_stem_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a report that are named like session files take the phone of the file."""
    c, n = table(spark, sf_dir, "customer"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    stems = c.select(F.concat(n, F.lit("_Sess")).alias("stem"), F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"))
    return normalise.stem_phones(c.select(F.concat(n, F.lit("_sess_jan")).alias("col")), stems)


@query("""SELECT '+91 98' || lpad((doc_id % 500)::VARCHAR, 8, '0') AS asked, doc_id, 'phones' AS kind FROM documents WHERE doc_id % 3 > 0""")
def j17_find_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents name a number, asked for in another form than they write it in."""
    number = F.concat(F.lit("98"), F.lpad((F.col("doc_id") % 500).cast("string"), 8, "0"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" call "), number, F.lit(". "))).otherwise("")).alias("text"), number.alias("n"))
    found = d.select("doc_id", F.explode(scalars.mentions(F.col("text"))["phones"]).alias("value"), F.lit("phones").alias("kind"))
    asked = d.where("doc_id % 3 > 0").select(F.concat(F.lit("+91 "), "n").alias("value")).distinct()
    return normalise.find_mentions(found, asked)


# ---------------------------------------------------------------- what readers are shown


@query(f"""{_FLAGS_SQL}, en AS (SELECT b.*, coalesce(t.n, 0) AS txn_count, coalesce(t.n, 0) + coalesce(co.n, 0) AS event_count, round(coalesce(m.s, 0), 2) AS volume FROM banded b LEFT JOIN (SELECT entity_id, count(*) AS n FROM ev WHERE event_type = 'TRANSACTION' GROUP BY 1) t USING (entity_id)
    LEFT JOIN co USING (entity_id) LEFT JOIN (SELECT entity_id, sum(amount) AS s FROM fl GROUP BY 1) m USING (entity_id))
    SELECT entity_id, risk_score, band, txn_count, event_count, volume, (SELECT count(*) FROM en) AS total FROM en ORDER BY risk_score DESC, typologies_fired DESC, raw_weight DESC, entity_id LIMIT 25 OFFSET 25""")
def p02_entities_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of entities by risk, with what moved and how much, and how many entities there are."""
    f, flags = _flags(spark, sf_dir)
    rows = reports.enriched(rules.score(f, flags), f)
    got = reports.page(rows, [F.desc("risk_score"), F.desc("typologies_fired"), F.desc("raw_weight"), "entity_id"], 25, 25)
    return got.select("entity_id", "risk_score", "band", "txn_count", "event_count", "volume", "total")


@query(f"""{_FLAGS_SQL}, o AS (SELECT entity_id, list_sort(list_distinct(list(rule))) AS r FROM flags GROUP BY 1)
    SELECT entity_id, 'Subject ' || entity_id || ' | Risk ' || printf('%.1f', risk_score) || ' (' || band || ') | Grounds: ' || replace(array_to_string(r[1:4], '; '), '_', ' ') || CASE WHEN len(r) > 4 THEN ' (+' || (len(r) - 4) || CASE len(r) WHEN 5 THEN ' further typology)' ELSE ' further typologies)' END ELSE '' END
    || ' | ' || CASE band WHEN 'high' THEN 'put forward for filing, subject to confirmation' ELSE 'flagged for review' END AS line FROM banded JOIN o USING (entity_id) WHERE band IN ('high', 'medium')""")
def p08_draft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, flags = _flags(spark, sf_dir)
    return reports.draft_lines(rules.score(f, flags), flags)


@query("""WITH f AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS kind, count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
    SELECT CASE kind WHEN 0 THEN 'CDR' WHEN 1 THEN 'BANK' END AS source, CASE kind WHEN 0 THEN 'calls' WHEN 1 THEN 'bank' END AS profile, count(*) AS files, sum(rows)::BIGINT AS rows, count(*) FILTER (kind > 0) AS manual FROM f GROUP BY 1, 2""")
def a26_ingestion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = exhibits.exhibits(spark, sf_dir)
    found = columns.detected(cells, columns.profile_table(spark, exhibits.PROFILES), by_value=False)
    return reports.ingestion_metrics(found, cells.groupBy("file").agg(F.count_distinct("row").alias("rows")))


# ---------------------------------------------------------------- what is known of entities beside what merges them

_WEAK = f"""{_IDS}, w AS (SELECT DISTINCT 'IP:10.' || regexp_extract(props, '([0-9]+)', 1) || '.0.' || (user_id % 7) AS identifier, 'PHONE:' || user_id AS m FROM events WHERE event_type = 'view'), weak AS (SELECT DISTINCT w.identifier, entity_id FROM w JOIN c ON c.identifier = w.m)"""


def _weak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    ip = F.concat(F.lit("IP:10."), F.regexp_extract("props", "([0-9]+)", 1), F.lit(".0."), (F.col("user_id") % 7).cast("string"))
    return e.select(ip.alias("a"), F.concat(F.lit("PHONE:"), F.col("user_id").cast("string")).alias("b"))


@query(f"WITH RECURSIVE {_WEAK} SELECT * FROM weak")
def r01_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with every entity whose phone was online from them; they merge nobody."""
    return entities.attached(_weak_edges(spark, sf_dir), entities.resolve(entities.identifier_edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_WEAK}, a AS (SELECT identifier, entity_id FROM c UNION ALL SELECT * FROM weak), h AS (SELECT 'PHONE:' || c_custkey AS identifier, c_name AS holder FROM customer WHERE c_custkey % 30 = 4),
    n AS (SELECT entity_id, arg_min(holder, a.identifier) FILTER (holder IS NOT NULL) AS holder, min(split_part(a.identifier, ':', 2)) FILTER (a.identifier LIKE 'PHONE:%') AS phone, min(split_part(a.identifier, ':', 2)) FILTER (a.identifier LIKE 'IP:%') AS ip, min(split_part(a.identifier, ':', 2)) FILTER (a.identifier LIKE 'IMEI:%') AS device
        FROM a LEFT JOIN h ON h.identifier = a.identifier GROUP BY 1)
    SELECT entity_id, coalesce(holder, phone, ip, device) AS label FROM n""")
def r02_holder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the name of a holder, else by a phone; every thirtieth phone has a name."""
    resolved = written(entities.resolve(entities.identifier_edges(spark, sf_dir)), "resolved")
    holders = table(spark, sf_dir, "customer").where("c_custkey % 30 = 4").select(F.concat(F.lit("PHONE:"), F.col("c_custkey").cast("string")).alias("identifier"), F.col("c_name").alias("holder"))
    return entities.entity_labels(resolved, entities.attached(_weak_edges(spark, sf_dir), resolved), holders)


@query("""SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00077') OR c_mktsegment ILIKE '%build%' AND contains('{"segment":"' || lower(c_mktsegment) || '","nation":' || c_nationkey || '}', 'building","nation":7') ORDER BY c_custkey LIMIT 500""")
def f27_workbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds by a text in names or in any attribute; two searches put together."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label"), F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")).alias("attributes"))
    found = search.workbench(c, "00077", order=["c_custkey"]).unionByName(search.workbench(c, 'Building","nation":7', order=["c_custkey"]))
    return found.select("c_custkey").distinct().orderBy("c_custkey").limit(search.SHOWN)


@query(f"""WITH {EVENTS_SQL} SELECT 'evt_' || event_id AS id, '{{"type":"' || event_type || '","start":"' || strftime(ts_start, '%Y-%m-%dT%H:%M:%S') || '","end":"' || strftime(ts_end, '%Y-%m-%dT%H:%M:%S') || '","minute_of_day":' || (hour(ts_start) * 60 + minute(ts_start)) || ',"entity":"' || entity_id || '"'
    || CASE WHEN cp IS NULL THEN '' ELSE ',"counterparty":"' || cp || '"' END || '}}' AS json FROM ev WHERE event_type <> 'TRANSACTION' AND entity_id IS NOT NULL""")
def f29_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and sessions as JSON text (amounts are left to tests: engines write doubles in different ways)."""
    return search.serialised(canonical_events(spark, sf_dir).where("event_type <> 'TRANSACTION' AND entity_id IS NOT NULL"))


@query(f"WITH {EVENTS_SQL} SELECT event_id FROM ev WHERE hour(ts_start) * 60 + minute(ts_start) BETWEEN 600 AND 660 AND dayname(ts_start) = 'Monday' AND lower(asset) = 'inr' ORDER BY ts_start DESC, event_id LIMIT 200")
def q03_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over fields that follow from time, and those that only some tables have."""
    q = search.Search(filters=(search.Test("minute_of_day", "between", values=(600, 660)), search.Test("weekday", "eq", "monday"), search.Test("asset", "eq", "INR")), limit=200)
    return search.run(canonical_events(spark, sf_dir), q).select("event_id")
