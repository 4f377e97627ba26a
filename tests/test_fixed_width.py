"""Printed reports: told apart from other text, columns, wrapped notes, repeated pages, headers over their columns."""

import pytest

from tracewell.plans import exhibits
from tracewell.sources import columns, fixed_width

LAYOUT = [3, 14, 48, 66, 80, 96, 112]
ROWS = [("19/07/21", "CU1901494271SHIV CREATION", "503851", None, 30000.00), ("26/07/21", "IMPS-120712183651-SIGNZY", "120712183651", None, 1.05), ("29/07/21", "DEBIT CARD ISSUANCE FEE", "CDT2120905123231", 236.00, None), ("06/08/21", "IMPS-121819086994-SIGNZY", "121819086994", None, 1.09), ("14/08/21", "NEFT CHARGE", "NEF2214009466183", 23.60, None), ("20/08/21", "ATW-419188XXXXXX9981-SURAT", "ATW2120905123999", 20000.00, None), ("25/08/21", "UPI-COLLECT-SIGNZY", "UPI2120905123111", None, 5000.00), ("02/09/21", "NEFT-DR-HDFC-VENDOR", "NEF2225009466999", 1500.00, None), ("10/09/21", "IMPS-CR-SIGNZY-REFUND", "IMP2225309466123", None, 250.75), ("15/09/21", "ATM WDL SURAT SAHARA", "ATW2225809466456", 493.29, None)]
PREAMBLE = ["       C/O SHIV CREATION                          City           : SURAT 395002", "       Nomination    : Registered                 Account No.    : 50200059660555     CARM", ""]


def line(*cells):
    out = ""
    for start, text in zip(LAYOUT, cells, strict=False):
        out = out.ljust(start) + str(text)
    return out


def statement(again=False):
    out, held = [*PREAMBLE], 0.0
    for i, (date, narr, ref, debit, credit) in enumerate(ROWS):
        held += (credit or 0) - (debit or 0)
        out.append(line(date, narr, ref, date, f"{debit:,.2f}" if debit else "", f"{credit:,.2f}" if credit else "", f"{held:,.2f}"))
        if i == 1:
            out += [line("", "TECHNOLOGIES-HDFC-ACCOUNT"), line("", "VERIFICATION")]
        if again and i == 5:
            out += PREAMBLE
    return [*out, "      Statement Summary"]


LEDGER = ["23-07-2025 18:20:58    BANK OF SOMEWHERE", "Branch : MAIN", "-" * 70, "  GL.       Value       Instrmnt   Particulars        Transaction", "  Date      Date         Number                      Debit Amount", "-" * 70, "Order by GL. Date."] + [f"0{i}-04-2024  0{i}-04-2024     6235{i} TO CASH {i}          1,10,000.00" for i in range(1, 9)]
FILES = {
    "printed": statement(),
    "pages": statement(again=True),
    "csv": ["Date,Narration,Debit,Credit"] + ["19/07/21,ATM,100.00,", "26/07/21,NEFT,,50.00"] * 3,
    "log": ["* Copyright *", "", "1207 logs output"] + [f"User: admin Date:02/12/2024 Time: 18:2{i}:54 made video search" for i in range(5)],
    "few": ["   19/07/21   ATM        100.00", "   26/07/21   NEFT        50.00"],
    "prose": [f"1{i}/07/21 we went to the shop  and back again" for i in range(6)],
    "ledger": LEDGER,
}


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(f, i, x) for f, own in FILES.items() for i, x in enumerate(own)], "file string, row int, line string")


def test_which_files_are_printed_reports(lines):
    got = {r.file: r.fixed for r in fixed_width.looks_fixed_width(lines).collect()}
    assert got == {"printed": True, "pages": True, "csv": False, "log": False, "few": False, "prose": False, "ledger": True}


def test_records_and_wrapped_notes(lines):
    cells = fixed_width.records(lines.where("file IN ('printed', 'pages')")).collect()
    for f in ("printed", "pages"):
        by = {(r.row, r.col): r.value for r in cells if r.file == f}
        assert {r for r, _ in by} == set(range(len(ROWS))) and {c for _, c in by} == set(range(7))
        assert [by[i, 0] for i in range(10)] == [r[0] for r in ROWS] and [by[i, 2] for i in range(10)] == [r[2] for r in ROWS]
        assert by[1, 1] == "IMPS-120712183651-SIGNZY TECHNOLOGIES-HDFC-ACCOUNT VERIFICATION"
        assert not any("Registered" in v or "Summary" in v for v in by.values()) and by[5, 4] == "20,000.00"
        assert all(r.header == f"column_{r.col}" for r in cells if r.file == f)


def test_headers_above_their_columns(lines):
    got = {r.col: r.header for r in fixed_width.headers(lines.where("file = 'ledger'")).collect()}
    assert got[0] == "GL. Date" and got[1] == "Value Date" and "Debit Amount" in " ".join(got.values()) and "Particulars" in " ".join(got.values())
    assert not any("Order" in h or "BANK" in h or "Branch" in h for h in got.values())
    assert fixed_width.headers(lines.where("false")).count() == 0 and fixed_width.records(lines.where("false")).count() == 0


def test_one_bad_line_joins_no_columns(spark):
    good = ["02-04-2024  02-04-2024     62353"] * 60
    got = fixed_width.columns(spark.createDataFrame([("f", i, x) for i, x in enumerate([*good, "02-04-2024xx02-04-2024xxxxx62353"])], "file string, row int, line string")).collect()
    assert sorted((r.begin, r.end) for r in got) == [(0, 10), (12, 22), (27, 32)]


def test_columns_without_names_are_found_by_their_values(spark, lines):
    """A printed statement has no header at all: its fields come from values, the debit column from the falling balance."""
    cells = fixed_width.records(lines.where("file = 'printed'"))
    p = columns.profile_table(spark, exhibits.PROFILES)
    found = columns.detected(cells, p)
    assert found.first().source == "BANK"
    values = columns.mapped_cells(cells, found, p).collect()
    at = {(r.row, r.target): r.value for r in values}
    assert at[2, "debit"] == "236.00" and at[0, "credit"] == "30,000.00" and (2, "credit") not in at and at[1, "attributes.narration"].endswith("VERIFICATION")
