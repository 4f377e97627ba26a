"""Grids: broken ones told apart, regions, merged headers, continued rows, promoted labels, preambles, sheets, identities."""

import pytest
from pyspark.sql import functions as F

from tracewell.sources import columns, regions

CLEAN = [["Tran Date", "Tran Particular", "Debit Amount", "Credit Amount", "Balance"], ["01-02-2024", "UPI/1234/PAY", "", "5000.00", "15000.00"], ["02-02-2024", "ATM WDL SURAT", "2000.00", "", "13000.00"], ["03-02-2024", "NEFT-HDFC-VENDOR", "1000.00", "", "12000.00"]]
GLUED = [
    ["S\nNo.", "Account No./ (Wallet", "Transaction ID", "Transaction\nAmount", "Transaction\nDate"],
    *[[str(i), "-:016901567850", f"41361107595{i}", "500000", "15-05-2024\nAM/PM: AM"] for i in range(1, 5)],
    ["S\nNo.", "Account\nNo./", "Action\nTaken by", "Bank", "Account Details", "Transaction Details", "Reference\nNo"],
    ["", "", "(Wallet/PG/PA)", "Merchant", "", "", ""],
    ["", "Transaction\nId / UTR", "", "", "", "", "Date of Action"],
    ["1", "8747048057", "Money Transfer to", "State Bank", "A/C No.-:42920748141 IFSC Code: SBIN0031048", "Transaction Amount-:135000 Txn Date: 14/05/2024", "NEFT:PUNBS241358"],
    ["", "4155178598", "", "", "", "", ""],
    ["", "Layer : 2", "", "", "", "", ""],
    ["2", "8747048057", "Money Transfer to", "South Bank", "A/C No.-:05700730011 IFSC Code: SIBL0000057", "Transaction Amount-:300000 Txn Date: 13/05/2024", "NRTGS/PUNBR520"],
    ["", "4155178598", "", "", "", "", ""],
    ["", "Layer : 2", "", "", "", "", ""],
]
PREAMBLE = [["Account Details", "", "", "", ""], ["Account No", "60532637196", "", "Open Date", "26/04/2025"], ["Account Holder", "Miss. A Person", "", "", ""], ["Phone No", "", "Email", "bom@example"], ["Address", "8-9 ROAD", "", ""]]
BELOW = [["Sr No", "Date", "Particulars", "Debit", "Credit"], ["1", "21/05/2025", "UPI 514185679876", "", "13,000.00"], ["2", "21/05/2025", "UPI 514179540681", "", "6,993.00"], ["3", "22/05/2025", "ATM WDL SURAT", "2,000.00", ""], ["4", "23/05/2025", "NEFT VENDOR", "1,500.00", ""]]
#: Page sums between the rows of one table, which goes on after a row of another width without its header.
PAGES = [["Date", "Memo", "Debit", "Credit", "Balance"]] + [r for p in range(4) for r in [*[[f"0{i}-06-2024", "to a shop", "", "1,000.00", "5,000.00"] for i in range(1, 5)], ["Page Total", "4,000.00"]]] + [["x", "y", "z", "w", "v", "u"]] * 2 + [[f"1{i}-06-2024", "on the next page", "", "2,000.00", "9,000.00"] for i in range(4)]


def grid(spark, files: dict):
    return spark.createDataFrame([(f, i, cells) for f, rows in files.items() for i, cells in enumerate(rows)], "file string, row int, cells array<string>")


@pytest.fixture(scope="module")
def all_files(spark):
    return grid(spark, {"clean": CLEAN, "glued": GLUED, "title": [["Details View & Print"]] + [[str(i)] for i in range(1, 8)], "small": [["a", "b"]], "below": PREAMBLE + BELOW, "pages": PAGES, "prose": [["1", "x"], ["2", "y"], ["3", "z"]] * 4, "empty": [["", ""]] * 5, "guard": [["123456789", "5.00", "x"]] * 8 + [["Date", "Memo", "Debit", "Credit"]] + [["01-02-2024", "x", "1.00", ""]] * 3})


def test_broken_grids(all_files):
    got = {r.file: r.broken for r in regions.needs_recovery(all_files).collect()}
    assert got == {"clean": False, "glued": True, "title": True, "small": False, "below": False, "pages": True, "prose": False, "empty": True, "guard": True}


def test_regions_of_glued_tables(all_files):
    found, cells = regions.recovered(all_files)
    by = {}
    for r in found.orderBy("file", "start").collect():
        by.setdefault(r.file, []).append(r)
    a, b = by["glued"]
    assert (a.start, a.records, a.header_rows) == (0, 4, 1) and (b.start, b.records, b.header_rows) == (5, 2, 3)
    assert "Wallet/PG/PA" in " ".join(b.headers) and "Date of Action" in " ".join(b.headers)
    at = {(r.row, r.header): r.value for r in cells.where(f"file = 'glued' AND region = {b.region}").collect()}
    assert "4155178598" in at[0, "Account No./ Transaction Id / UTR"]
    assert (at[0, "Txn Date"], at[1, "Txn Date"], at[0, "A/C No"]) == ("14/05/2024", "13/05/2024", "42920748141")
    assert not any(h == "Layer" for _, h in at)
    assert not {"empty", "small", "guard"} & set(by) and by["prose"][0].records == 4  # a grid of which too little is placed has no regions
    assert by["below"][0].start == len(PREAMBLE)
    above = regions.preambles(all_files, found).where("file = 'below'").collect()
    assert len(above) == len(PREAMBLE) and any("60532637196" in c for r in above for c in r.cells)


def test_page_sums_and_tables_that_go_on(all_files):
    found, cells = regions.recovered(all_files, promote=False)
    got = found.where("file = 'pages'").orderBy("start").collect()
    assert [(r.start, r.records, r.header_rows) for r in got] == [(0, 16, 1), (23, 4, 0)] and got[1].headers == PAGES[0]
    values = [r.value for r in cells.where("file = 'pages' AND header = 'Date'").collect()]
    assert len(values) == 20 and not any("Total" in v for v in values)


def test_rows_that_are_labels(spark):
    rows = [["", "", "40.00Cr"], ["", "1,234.00Dr"], ["Trans Date", "Value Date", "Debit"], ["1", "2", "x"], ["", ""], ["12-05-2024", "a"], ["123456789", "a"]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>").select("i", regions.is_label(F.col("cells")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [False, False, True, False, False, False, False]


def test_header_rows_sheets_and_records(spark):
    aliases = ["date", "memo", "debit"]
    sheets = [("a", 0, [["Cover"], ["Date", "of issue"]] + [["x"]] * 9), ("a", 1, [["Bank"], [" DATE ", "Memo", "Debit", "", "Debit"], ["1", "2", "3", "4", "5"], ["", "", "total"], ["", ""], ["6"]]), ("b", 0, [["x"]]), ("b", 1, [["y"], ["z"]]), ("c", 0, [["Date"] * 2, ["Date"] * 2])]
    g = spark.createDataFrame([(f, s, i, c) for f, s, rows in sheets for i, c in enumerate(rows)], "file string, sheet int, row int, cells array<string>")
    best = regions.best_sheets(g, aliases)
    assert {(r.file, r.sheet) for r in best.select("file", "sheet").distinct().collect()} == {("a", 1), ("b", 1), ("c", 0)}
    heads = regions.header_rows(best, aliases)
    assert {r.file: r.header for r in heads.collect()} == {"a": 1, "b": 0, "c": 0}
    cells, blank = regions.grid_records(best, heads)
    got = {(r.row, r.header): r.value for r in cells.where("file = 'a'").collect()}
    assert got == {(0, "DATE"): "1", (0, "Memo"): "2", (0, "Debit"): "3", (0, "column_3"): "4", (0, "Debit__2"): "5", (1, "DATE"): "6", (1, "Memo"): "", (1, "Debit"): "", (1, "column_3"): "", (1, "Debit__2"): ""}
    assert {r.file: r.blank_rows for r in blank.collect()} == {"a": 2}


def test_identities(spark):
    above = grid(spark, {"cells": [["Account No:", "", "5010 0234-567890"], ["Mobile", "+91", "8180934367"], ["Account Holder", "Anna Smith", "x"], ["Mobile", "+91"]], "text": [["x"]]})
    text = spark.createDataFrame([("text", "Statement\nAccount No.    : 50200059660555\nMobile : +91 81809 34367  Branch\nCustomer Name: JOHN DOE\n"), ("cells", "Account No: 999999999"), ("code", "Mobile: +91\n")], "file string, text string")
    got = {(r.file, r.field): r.value for r in regions.identities(above, text).collect()}
    assert got == {("cells", "account_no"): "50100234567890", ("cells", "registered_mobile"): "+918180934367", ("cells", "account_holder"): "Anna Smith", ("text", "account_no"): "50200059660555", ("text", "registered_mobile"): "+918180934367", ("text", "account_holder"): "JOHN DOE"}
    assert regions.identities(above.where("false")).count() == 0


def test_recovered_tables_are_mapped_by_the_usual_way(spark):
    """Regions of a portal's export come out of the same detection and mapping as any file."""
    _, cells = regions.recovered(grid(spark, {"glued": GLUED}))
    profile = [{"name": "portal", "source": "BANK", "fields": {"timestamp_start": ["Txn Date", "Transaction Date"], "account_no": ["A/C No", "Account No./ (Wallet"], "amount": ["Transaction Amount"]}}]
    p = columns.profile_table(spark, profile)
    whole = cells.withColumn("file", F.concat_ws("#", "file", "region")).drop("region")
    found = columns.detected(whole, p, by_value=False)
    assert {r.source for r in found.collect()} == {"BANK"}
    dates = {r.value for r in columns.mapped_cells(whole, found, p).where("target = 'timestamp_start'").collect()}
    assert "14/05/2024" in dates and any(d.startswith("15-05-2024") for d in dates)
