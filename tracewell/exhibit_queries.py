"""Registered queries over messy files made of the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans import exhibits
from tracewell.queries import query
from tracewell.scratch import table, written
from tracewell.sources import columns, fixed_width, regions

# ---------------------------------------------------------------- columns by their values

_STATEMENTS = """m AS (SELECT o_custkey AS file, o_orderkey AS event_id, o_orderdate AS ts, printf('%.2f', round(o_totalprice, 2)) AS amount, o_orderstatus = 'F' AS credit,
        row_number() OVER w - 1 AS row, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS held
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    s AS (SELECT *, CASE WHEN NOT credit OR file % 5 = 0 AND event_id % 4 = 0 THEN amount ELSE '' END AS o, CASE WHEN credit OR file % 5 = 0 AND event_id % 4 = 0 THEN amount ELSE '' END AS i FROM m),
    cells AS (SELECT file, row, 0 AS col, (row + 1)::VARCHAR AS v FROM s UNION ALL SELECT file, row, 1, strftime(ts, '%d-%m-%Y %H:%M:%S') FROM s
        UNION ALL SELECT file, row, 2, '501' || lpad(file::VARCHAR, 11, '0') FROM s UNION ALL SELECT file, row, 3, 'UPI/' || lpad(event_id::VARCHAR, 12, '4') || '/PAY/a@okbank' FROM s
        UNION ALL SELECT file, row, 4, CASE WHEN file % 2 = 1 THEN i ELSE o END FROM s UNION ALL SELECT file, row, 5, CASE WHEN file % 2 = 1 THEN o ELSE i END FROM s
        UNION ALL SELECT file, row, 6, CASE WHEN file % 7 = 0 THEN '' ELSE printf('%.2f', held) END FROM s)"""

#: The kinds that occur in these cells: their patterns in short, since the cells are in one form.
_TYPES = f"""{_STATEMENTS},
    p AS (SELECT file, col, v, regexp_full_match(v, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}} [0-9:]{{8}}') AS stamp,
        regexp_full_match(v, '-?[0-9]+([.][0-9]{{1,4}})?') AND (v LIKE '%.%' OR length(v) <= 8) AS amount, regexp_full_match(v, '[0-9]{{9,20}}') AS account,
        length(v) >= 12 AND regexp_matches(v, '[ /-]') AND regexp_matches(v, '[A-Za-z]') AS narration, CASE WHEN regexp_full_match(v, '[0-9]{{1,12}}') THEN v::BIGINT END AS x,
        try_cast(v AS DOUBLE) AS num FROM cells WHERE v <> '' AND row < 400),
    g AS (SELECT file, col, count(*) AS n, avg(stamp::INT) AS stamp, avg(amount::INT) AS amount, avg(account::INT) AS account, avg(narration::INT) AS narration,
        avg(coalesce(x BETWEEN 1 AND 65535, false)::INT) AS port, avg(coalesce(x BETWEEN 0 AND 604800, false)::INT) AS duration, avg(coalesce(x BETWEEN 0 AND 1000000000000, false)::INT) AS bytes,
        count(DISTINCT v) / count(*) AS ratio, count(DISTINCT length(v)) FILTER (account) AS lengths, avg((v LIKE '%.%')::INT) AS tells, max(length(regexp_replace(v, '[^0-9]', '', 'g'))) AS longest,
        count(num) AS k, count(DISTINCT num::BIGINT) AS kd, min(trunc(num)) AS lo, max(trunc(num)) AS hi FROM p GROUP BY 1, 2),
    t AS (SELECT *, n >= 5 AND k >= 0.85 * n AND k >= 5 AND lo <= 3 AND hi <= 3 * k AND kd >= 0.7 * (hi - lo + 1) AS serial FROM g),
    types AS (SELECT file, col, n, coalesce(serial, false) AS serial, CASE WHEN n < 4 OR coalesce(serial, false) THEN [] ELSE list_sort(list_filter([CASE WHEN stamp >= 0.6 THEN 'datetime' END,
        CASE WHEN amount >= 0.75 AND (tells >= 0.2 OR longest >= 3) THEN 'amount' END, CASE WHEN account >= 0.75 THEN CASE WHEN ratio > 0.95 AND lengths <= 1 THEN 'reference_like' ELSE 'account_like' END END,
        CASE WHEN narration >= 0.75 AND stamp < 0.5 THEN 'narration' END, CASE WHEN port >= 0.75 THEN 'port' END, CASE WHEN duration >= 0.75 THEN 'duration' END, CASE WHEN bytes >= 0.75 THEN 'bytes' END], lambda z: z IS NOT NULL)) END AS kinds FROM t)"""

_PAIRS = f"""{_TYPES}, am AS (SELECT file, col FROM types WHERE list_contains(kinds, 'amount')),
    r AS (SELECT file, row, col, v <> '' AS filled FROM cells JOIN am USING (file, col) WHERE row < 400),
    pr AS (SELECT x.file, x.col AS a, y.col AS b, count(*) AS n, count(*) FILTER (x.filled OR y.filled) AS any_, count(*) FILTER (x.filled <> y.filled) AS one FROM r x JOIN r y ON x.file = y.file AND x.row = y.row AND x.col < y.col GROUP BY 1, 2, 3),
    pairs AS (SELECT file, a, b, round(one / any_, 4) AS exclusivity FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY one / any_ DESC, a, b) AS k FROM pr WHERE n >= 4 AND any_ >= 4 AND one >= 0.85 * any_) WHERE k = 1)"""


@query("""WITH o AS (SELECT o_custkey % 5 AS file, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS row, o_orderkey % 4 > 0 AS filled FROM orders),
    i AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row) - 1 AS i, count(*) OVER (PARTITION BY file) AS n FROM o WHERE row < 400 AND filled)
    SELECT file, count(*) AS kept, sum(row)::BIGINT AS rows FROM i WHERE n <= 200 OR list_contains(list_transform(range(200), lambda k: k * n // 200), i) GROUP BY file""")
def g15_column_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that stand for a column: 200 of its first 400, evenly spread. Five files of all orders."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("file"), "o_orderkey", "o_totalprice")
    row = F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey")) - 1
    cells = o.select("file", row.alias("row"), F.lit(0).alias("col"), F.lit("Sum").alias("header"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice").cast("string")).alias("value"))
    return columns.sampled(cells).groupBy("file").agg(F.count("*").alias("kept"), F.sum("row").alias("rows"))


@query(f"WITH {_TYPES} SELECT file, col, n, array_to_string(kinds, ',') AS kinds FROM types")
def g17_column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = columns.column_types(exhibits.statements(spark, sf_dir))
    return t.select("file", "col", "n", F.array_join(F.array_sort(F.map_keys("kinds")), ",").alias("kinds"))


@query(f"WITH {_TYPES} SELECT file, col, serial FROM types")
def g18_serial_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.column_types(exhibits.statements(spark, sf_dir)).select("file", "col", "serial")


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def g21_amount_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = exhibits.statements(spark, sf_dir)
    return columns.amount_pairs(cells, columns.column_types(cells))


@query(f"""WITH {_PAIRS}, bal AS (SELECT file, 6 AS balance FROM am JOIN pairs USING (file) WHERE col = 6),
    w AS (SELECT s.file, s.row, a, b, balance, CASE WHEN s.file % 2 = 1 THEN i ELSE o END <> '' AS in_a, CASE WHEN s.file % 2 = 1 THEN o ELSE i END <> '' AS in_b,
          CASE WHEN balance IS NOT NULL THEN held - lag(held) OVER (PARTITION BY s.file ORDER BY s.row) END AS step FROM s JOIN pairs ON pairs.file = s.file LEFT JOIN bal ON bal.file = s.file WHERE s.row < 400),
    z AS (SELECT file, a, b, balance, sum(coalesce(-sign(step), 0) * (in_a::INT - in_b::INT)) AS t FROM w GROUP BY ALL)
    SELECT file, CASE WHEN t < 0 THEN b ELSE a END AS debit, CASE WHEN t < 0 THEN a ELSE b END AS credit, balance FROM z""")
def g22_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debit and credit columns under headers that don't tell, from where the balance falls."""
    cells = exhibits.statements(spark, sf_dir)
    types = written(columns.column_types(cells), "types")
    return columns.oriented_pairs(cells, types, written(columns.amount_pairs(cells, types), "pairs"))


@query()
def g20_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field for each column of every statement. Likeness of names is no SQL; a test holds it against brute force."""
    profiles = columns.profile_table(spark, exhibits.PROFILES)
    return columns.inferred_targets(exhibits.statements(spark, sf_dir), profiles).where("profile = 'bank'").select("file", "header", "target", F.round("confidence", 4).alias("confidence"))


@query()
def g23_value_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose headers say nothing, claimed by their values; held against brute force by a test."""
    found = columns.detected(exhibits.statements(spark, sf_dir), columns.profile_table(spark, exhibits.PROFILES))
    return found.select("file", "profile", "source", "confidence", "needs_manual_mapping", F.size("value_map").cast("long").alias("fields"))


_FIELDS = "pf(profile, place, target, alias) AS (VALUES " + ", ".join(f"('{p['name']}', {i}, '{t}', '{a.lower()}')" for i, p in enumerate(exhibits.PROFILES) for t, names in p["fields"].items() for a in names) + ")"
_NEEDS = "anyof(profile, alias) AS (VALUES " + ", ".join(f"('{p['name']}', '{a}')" for p in exhibits.PROFILES for a in p.get("required_any", [])) + "), allof(profile, alias) AS (VALUES " + ", ".join(f"('{p['name']}', '{a}')" for p in exhibits.PROFILES for a in p.get("required_all", [])) + ")"
_EXHIBITS = """ex AS (SELECT *, CASE WHEN et = 'click' THEN 0 WHEN et = 'purchase' THEN 1 WHEN et = 'signup' THEN 2 ELSE 3 END AS kind FROM (SELECT event_id, ts, user_id, event_type AS et FROM events WHERE event_type <> 'error') x),
    hd AS (SELECT DISTINCT user_id * 4 + kind AS file, unnest(CASE kind WHEN 0 THEN ['calling party number', 'called party number', 'call date', 'duration'] WHEN 1 THEN ['txn date', 'debit', 'amount', 'folio']
        WHEN 2 THEN ['designation', 'mobile number', 'account no.'] ELSE ['code', 'held'] END) AS alias FROM ex)"""
_MATCHES = f"""{_FIELDS}, {_NEEDS}, {_EXHIBITS}, sz AS (SELECT profile, place, count(DISTINCT target) AS fields FROM pf GROUP BY 1, 2),
    hit AS (SELECT file, profile, place, list_distinct(list(target)) AS ts FROM hd JOIN pf USING (alias) GROUP BY 1, 2, 3),
    sc AS (SELECT h.file, h.profile, h.place, CASE WHEN EXISTS (SELECT 1 FROM allof a WHERE a.profile = h.profile AND NOT EXISTS (SELECT 1 FROM hd WHERE hd.file = h.file AND hd.alias = a.alias)) THEN 0
        WHEN NOT EXISTS (SELECT 1 FROM anyof a WHERE a.profile = h.profile) OR EXISTS (SELECT 1 FROM anyof a JOIN hd ON hd.alias = a.alias WHERE a.profile = h.profile AND hd.file = h.file) THEN len(ts) / fields
        WHEN len(ts) >= 3 AND list_has_any(ts, ['timestamp_start', 'datetime_col', 'date_col']) AND list_has_any(ts, ['account_no', 'amount', 'debit', 'credit', 'phone', 'imei']) THEN least(len(ts) / fields, 0.49) ELSE 0 END AS c
        FROM hit h JOIN sz ON sz.profile = h.profile)"""


@query(f"WITH {_MATCHES} SELECT file, profile, round(c, 4) AS confidence FROM sc WHERE c > 0")
def g12_profile_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by their headers, with those that must be there and the fallback of files that have none of these."""
    m = columns.profile_matches(exhibits.exhibits(spark, sf_dir), columns.profile_table(spark, exhibits.PROFILES))
    return m.select("file", "profile", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {_MATCHES}, b AS (SELECT file, profile, round(c, 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, place) AS k FROM sc WHERE c > 0) x WHERE k = 1)
    SELECT DISTINCT hd.file, b.profile, coalesce(confidence, 0) AS confidence, coalesce(confidence, 0) < 0.55 AS needs_manual_mapping FROM hd LEFT JOIN b ON b.file = hd.file""")
def g14_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = columns.detected(exhibits.exhibits(spark, sf_dir), columns.profile_table(spark, exhibits.PROFILES), by_value=False)
    return found.select("file", "profile", "confidence", "needs_manual_mapping")


@query(f"""WITH {_EXHIBITS}, f AS (SELECT user_id * 4 + kind AS file, kind, user_id, count(*) AS rows FROM ex GROUP BY ALL),
    r AS (SELECT file, rows, CASE WHEN kind = 2 THEN 'refused_officer_bearing' WHEN rows < 3 OR kind = 3 AND user_id % 2 = 1 THEN 'out_of_scope_no_canonical_field'
        WHEN kind = 3 THEN 'reference_no_time_anchor' ELSE 'unread_parser_gap' END AS reason FROM f)
    SELECT reason, count(*) AS tables, sum(rows)::BIGINT AS rows FROM r GROUP BY reason""")
def g25_unrecognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why files are not claimed: one row for each reason."""
    u = columns.unrecognised(exhibits.exhibits(spark, sf_dir))
    return u.groupBy("reason").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))


@query(f"""WITH {_EXHIBITS}, e AS (SELECT *, row_number() OVER (PARTITION BY user_id, et ORDER BY ts, event_id) - 1 AS row, regexp_extract(props, '([0-9]+)', 1)::INT AS k, value FROM ex JOIN (SELECT event_id, props, value FROM events) USING (event_id))
    SELECT target, count(*) AS cells, count(DISTINCT file) AS files FROM (SELECT user_id * 4 + kind AS file, unnest(CASE kind WHEN 0 THEN ['entity_phone', 'counterparty_phone', 'timestamp_start', 'attributes.duration'] WHEN 1 THEN ['timestamp_start', 'debit', 'amount'] ELSE [] END) AS target FROM e) x GROUP BY target""")
def f01_mapped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every record of all files at once, by the profile that each file's headers match."""
    cells, profiles = exhibits.exhibits(spark, sf_dir), columns.profile_table(spark, exhibits.PROFILES)
    found = columns.detected(cells, profiles, by_value=False)
    return columns.mapped_cells(cells, written(found, "found"), profiles).groupBy("target").agg(F.count("*").alias("cells"), F.count_distinct("file").alias("files"))


# ---------------------------------------------------------------- grids

_BOOKS = """bm AS (SELECT o_custkey AS file, o_orderkey AS k, strftime(o_orderdate, '%d-%m-%Y') AS d, printf('%.2f', round(o_totalprice, 2)) AS amount, o_orderstatus = 'F' AS credit,
        (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS i FROM orders), bf AS (SELECT DISTINCT file FROM bm),
    books AS (SELECT file, 0 AS sheet, (x).r AS row, (x).c AS cells FROM (SELECT file, unnest([{'r': 0, 'c': ['Statement of account']}, {'r': 1, 'c': ['Account No', '501' || lpad(file::VARCHAR, 11, '0')]},
            {'r': 2, 'c': ['Account Holder', 'Customer ' || file, 'Main']}, {'r': 3, 'c': ['Mobile', '+91', '98' || lpad(file::VARCHAR, 8, '0')]}]) AS x FROM bf)
        UNION ALL SELECT file, 1, p::INT, ['Page', (p + 1)::VARCHAR] FROM bf, range(3) r(p) WHERE p < file % 4 UNION ALL SELECT file, 1, (file % 4)::INT, ['Txn Date', 'Memo', 'Debit', 'Credit', 'Balance'] FROM bf
        UNION ALL SELECT file, 1, (file % 4)::INT + 1 + i + i // 3, [d, 'to ' || k, CASE WHEN credit THEN '' ELSE amount END, CASE WHEN credit THEN amount ELSE '' END, (k % 1000) || '.00'] FROM bm
        UNION ALL SELECT file, 1, (file % 4)::INT + 2 + i + i // 3, ['', '', 'Page Total', '', ''] FROM bm WHERE i % 3 = 2)"""
_WORDS = sorted({a.lower() for p in exhibits.PROFILES for names in p["fields"].values() for a in names})
_HEADS = f"""{_BOOKS}, bh AS (SELECT file, sheet, row, CASE WHEN row < 40 THEN len(list_filter(cells, lambda c: list_contains({_WORDS}, lower(trim(c))))) ELSE 0 END AS hits FROM books),
    top AS (SELECT file, sheet, CASE WHEN hits >= 2 THEN row ELSE 0 END AS header, hits FROM (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY hits DESC, row) AS n FROM bh) WHERE n = 1)"""


@query(f"WITH {_HEADS} SELECT file, sheet, header, hits FROM top")
def s04_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header row of every sheet of every workbook, in one pass."""
    return regions.header_rows(exhibits.workbooks(spark, sf_dir), _WORDS, ("file", "sheet")).select("file", "sheet", "header", F.col("hits").cast("long").alias("hits"))


@query(f"""WITH {_HEADS}, sc AS (SELECT b.file, b.sheet, count(*) AS rows, max(CASE WHEN b.row = t.header THEN len(list_filter(cells, lambda c: list_contains({_WORDS}, lower(trim(c))))) ELSE 0 END) AS h
        FROM books b JOIN top t ON t.file = b.file AND t.sheet = b.sheet GROUP BY 1, 2)
    SELECT file, sheet, rows FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY h DESC, rows DESC, sheet) AS n FROM sc) WHERE n = 1""")
def s06_best_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = regions.best_sheets(exhibits.workbooks(spark, sf_dir), _WORDS)
    return best.groupBy("file", "sheet").agg(F.count("*").alias("rows"))


@query(f"""WITH {_BOOKS}, g AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row) - 1 AS record FROM books WHERE sheet = 1 AND row > file % 4 AND cells[1] || cells[2] <> '')
    SELECT file, record AS row, (unnest(list_transform(cells, lambda c, i: {{'h': ['Txn Date', 'Memo', 'Debit', 'Credit', 'Balance'][i], 'v': c}}))).h AS header, (unnest(list_transform(cells, lambda c, i: {{'h': i, 'v': c}}))).v AS value FROM g""")
def g02_grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records below the header row of the best sheet; rows with nothing in their first two cells are none."""
    best = regions.best_sheets(exhibits.workbooks(spark, sf_dir), _WORDS)
    cells, _ = regions.grid_records(best, regions.header_rows(best, _WORDS))
    return cells.select("file", "row", "header", "value")


@query(f"WITH {_BOOKS} SELECT file, 'account_no' AS field, cells[2] AS value FROM books WHERE sheet = 0 AND row = 1 UNION ALL SELECT file, 'account_holder', cells[2] FROM books WHERE sheet = 0 AND row = 2 UNION ALL SELECT file, 'registered_mobile', cells[2] || cells[3] FROM books WHERE sheet = 0 AND row = 3")
def g11_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.identities(exhibits.workbooks(spark, sf_dir).where("sheet = 0").select("file", "row", "cells"))


_DATA = r"regexp_matches(c, '\b[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}\b') OR regexp_full_match(c, '[0-9]+[.][0-9]{2}') OR regexp_matches(c, '[0-9]{9,}')"
_GLUED = f"""{_BOOKS}, g AS (SELECT file, row + 4 * sheet AS row, cells, len(cells) AS w, list_filter(cells, lambda c: c <> '') AS own FROM books),
    lb AS (SELECT *, len(own) > 0 AND len(list_filter(own, lambda c: {_DATA})) = 0 AND 2 * len(list_filter(own, lambda c: regexp_matches(c, '[A-Za-z]'))) >= len(own) AS label FROM g),
    wd AS (SELECT file, w, count(*) AS n FROM g WHERE len(own) > 0 GROUP BY 1, 2), us AS (SELECT file, coalesce(max(w) FILTER (n >= 3), max(w)) AS usual, count(*) FILTER (n >= 3) AS widths FROM wd GROUP BY file)"""
_REGIONS = f"""{_GLUED}, k AS (SELECT lb.*, usual, CASE WHEN len(own) > 0 AND w >= 0.6 * usual THEN w END AS kw FROM lb JOIN us USING (file)),
    n AS (SELECT *, (kw IS NOT NULL AND kw IS DISTINCT FROM last_value(kw IGNORE NULLS) OVER (PARTITION BY file ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS fresh FROM k),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY row) AS span FROM n),
    z AS (SELECT *, count(*) OVER (PARTITION BY file, span) AS len_, row_number() OVER (PARTITION BY file, span ORDER BY row) - 1 AS place, min(row) OVER (PARTITION BY file, span) AS start,
        sum((NOT label)::INT) OVER (PARTITION BY file, span ORDER BY row) AS stops FROM s WHERE span > 0),
    h AS (SELECT file, span, any_value(len_) AS len_, any_value(start) AS start, count(*) FILTER (stops = 0 AND place < 8) AS heads, list(cells ORDER BY row) FILTER (stops = 0 AND place < 8) AS hs, max(len(cells)) FILTER (place = 0) AS w FROM z WHERE len_ >= 3 GROUP BY 1, 2),
    hn AS (SELECT *, CASE WHEN heads > 0 AND len(list_filter(range(1, w + 1), lambda i: len(list_filter(hs, lambda r: coalesce(r[i], '') <> '')) > 0)) >= 2 THEN w END AS named FROM h),
    hk AS (SELECT *, CASE WHEN heads > 0 THEN named ELSE last_value(named IGNORE NULLS) OVER (PARTITION BY file ORDER BY span) END AS cols FROM hn),
    b AS (SELECT z.file, z.span, z.row, z.cells[1] AS first FROM z JOIN hk ON hk.file = z.file AND hk.span = z.span WHERE cols IS NOT NULL AND place >= heads AND len(own) > 0 AND NOT regexp_matches(cells[1], '(?i)^ *(page +)?(sub *)?total')),
    r AS (SELECT file, span, count(*) FILTER (first <> '' OR n = 1) AS records FROM (SELECT *, row_number() OVER (PARTITION BY file, span ORDER BY row) AS n FROM b) GROUP BY 1, 2),
    a AS (SELECT file, sum(len_) AS placed FROM hk JOIN r USING (file, span) GROUP BY file), t AS (SELECT file, count(*) AS filled FROM g WHERE len(own) > 0 GROUP BY file),
    found AS (SELECT hk.file, hk.start, heads AS header_rows, records FROM hk JOIN r ON r.file = hk.file AND r.span = hk.span JOIN a ON a.file = hk.file JOIN t ON t.file = hk.file WHERE placed >= 0.5 * filled)"""


@query(f"""WITH {_GLUED}, hd AS (SELECT file, count(*) AS rows, bool_or(row < 8 AND label AND len(own) >= 2) AS headed FROM lb GROUP BY file)
    SELECT file, rows >= 3 AND (widths >= 2 OR NOT headed) AS broken FROM hd JOIN us USING (file)""")
def g04_broken_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.needs_recovery(exhibits.glued(spark, sf_dir))


@query(f"WITH {_REGIONS} SELECT file, start, header_rows, records FROM found")
def g09_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables recovered from grids in which a cover and a table are glued together."""
    found, _ = regions.recovered(exhibits.glued(spark, sf_dir), promote=False)
    return found.select("file", "start", F.col("header_rows").cast("long").alias("header_rows"), "records")


@query(f"WITH {_REGIONS}, f AS (SELECT file, min(start) AS first FROM found GROUP BY file) SELECT g.file, g.row, array_to_string(cells, '|') AS text FROM g JOIN f USING (file) WHERE row < first")
def g10_preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = exhibits.glued(spark, sf_dir)
    found, _ = regions.recovered(grid, promote=False)
    return regions.preambles(grid, found).select("file", "row", F.array_join("cells", "|").alias("text"))


# ---------------------------------------------------------------- printed reports

_PRINTED = """pm AS (SELECT o_custkey AS file, o_orderkey AS k, strftime(o_orderdate, '%d-%m-%Y') AS d, printf('%.2f', round(o_totalprice, 2)) AS amount, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS i,
        count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""


@query(f"WITH {_PRINTED} SELECT DISTINCT file, n >= 4 AS fixed FROM pm")
def s12_printed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are printed reports: those with four records or more."""
    return fixed_width.looks_fixed_width(exhibits.printed(spark, sf_dir))


@query(f"""WITH {_PRINTED} SELECT file, i AS row, (unnest(v)).c::INT AS col, (unnest(v)).v AS value FROM (SELECT file, i, [{{'c': 0, 'v': d}}, {{'c': 1, 'v': 'TO CASH ' || k || CASE WHEN i % 4 = 3 AND i < n - 1 THEN ' BRANCH ' || (file % 10) ELSE '' END}},
    {{'c': 2, 'v': amount}}, {{'c': 3, 'v': (k % 1000 + 1000) || '.00'}}] AS v FROM pm) x""")
def s14_printed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all printed reports at once, cut at the columns that their lines share, wrapped notes joined."""
    return fixed_width.records(exhibits.printed(spark, sf_dir)).select("file", F.col("row").cast("int").alias("row"), "col", "value")


@query("SELECT file, (unnest(h)).c::INT AS col, (unnest(h)).n AS header FROM (SELECT DISTINCT o_custkey AS file, [{'c': 0, 'n': 'GL. Date'}, {'c': 1, 'n': 'Particulars of movement'}, {'c': 2, 'n': 'Debit Amount'}, {'c': 3, 'n': 'Closing Balance'}] AS h FROM orders) x")
def s15_printed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of a printed report's columns, from two lines above its first record."""
    return fixed_width.headers(exhibits.printed(spark, sf_dir))
