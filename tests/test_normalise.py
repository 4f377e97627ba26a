"""Normalisers of mapped rows, by hand-made cases."""

from pyspark.sql import functions as F

from tracewell.functions import narration
from tracewell.operators import normalise


def test_narrations(spark):
    cases = ["UPI/9876543210@ybl/John Doe/100000012345", "NEFT/11161241340@sbi/x", "IMPS/a/Bo/b", "", None]
    got = [r.m for r in spark.createDataFrame([(c,) for c in cases], "n string").select(narration.mine(F.col("n")).alias("m")).collect()]
    assert (got[0].phone, got[0].utr, got[0].mode, got[0].name, got[0].upi_id) == ("9876543210", "100000012345", "UPI", "John Doe", "9876543210@ybl")
    assert (got[1].account, got[1].phone) == ("11161241340", None)
    assert got[2].name == "Bo" and got[3].name is None


def test_bank_rows(spark):
    schema = "when string, account_no string, header_account string, registered_mobile string, narration string, debit string, credit string, amount string"
    rows = [("05/01/2024 10:00:00", None, "-:123456789", "9876543210", "UPI/9000000001@ybl", "1,000.50", None, None), ("05/01/2024", "555555555", "123456789", "9876543210", None, "0", "0", "-7"), ("10:00", "1", None, None, None, None, None, None), ("05/01/2024", None, None, None, None, None, None, "0")]
    got = normalise.bank(spark.createDataFrame(rows, schema)).collect()
    assert (got[0].amount, got[0].direction, got[0].primary_id.id_value, got[0].counterparty_id.id_type) == (1000.5, "DEBIT", "123456789", "PHONE")
    assert [i.id_type for i in got[0].own_ids] == ["ACCOUNT_NO", "PHONE"] and [i.id_type for i in got[1].own_ids] == ["ACCOUNT_NO"]
    assert (got[1].amount, got[1].direction) == (7.0, "DEBIT")
    assert got[2].reason == "no timestamp" and got[3].reason == "timestamp but no identifier" and got[3].direction == "CREDIT"


def test_calls_and_sessions(spark):
    c = spark.createDataFrame([("2024-01-05 10:00:00", "9876543210", "0912345678", "60", "MOC", "123456789012345", "x/9876543210_cdr.csv"), ("2024-01-05 10:00:00", "9876543211", None, "x", "MTC", "123456789012345", "x/9876543210_cdr.csv")], "when string, a_party string, b_party string, duration string, call_type string, imei string, source_file string")
    a, b = normalise.calls(c).collect()
    assert [i.id_type for i in a.own_ids] == ["PHONE", "IMEI"] and [i.id_type for i in b.own_ids] == ["PHONE"]
    assert (a.ts_end - a.ts_start).seconds == 60 and b.ts_end is None and b.duration is None
    s = spark.createDataFrame([("2024-01-05 10:00:00", "9876543210", "2001:db8:1:2::1", None), ("2024-01-05 11:00:00", None, "2001:db8:1:2::9", None), ("2024-01-05 11:00:00", None, None, None)], "when string, subscriber string, public_ip string, private_ip string")
    rows = sorted(normalise.prefix_phones(normalise.sessions(s)).collect(), key=lambda r: (r.public_ip or "~"))
    assert rows[1].upgraded and rows[1].primary_id.id_value == "+919876543210" and rows[2].reason == "timestamp but no identifier"


def test_crypto_pairs_and_stems(spark):
    rates = spark.createDataFrame([("BTC", 100.0)], "token string, inr double")
    rows = spark.createDataFrame([("2024-01-05 00:00:00", "a", "b", "2.5", "BTC"), ("2024-01-05 00:00:00", "a", "", "1", None)], "when string, from_addr string, to_addr string, amount string, token string")
    got = {r.token: r for r in normalise.crypto(rows, rates).collect()}
    assert got["BTC"].value_inr == 250.0 and str(got["BTC"].ts_start) == "2024-01-05 05:30:00" and got["CRYPTO"].reason == "timestamp but no identifier"
    reply = spark.createDataFrame([("111111111, 222222222", "+91 9876543210 / 09876543211"), (None, None)], "acc string, mob string")
    assert normalise.reply_pairs(reply, "acc", "mob").count() in (2, 4)
    stems = spark.createDataFrame([("9876543210_ipdr_long_name", "+911"), ("abcdef", "+912")], "stem string, phone string")
    cols = spark.createDataFrame([("ABCDEF",), ("ipdr_long",), ("abcdefgh",), ("none of these",)], "col string")
    assert {r.col: r.phone for r in normalise.stem_phones(cols, stems).collect()} == {"ABCDEF": "+912", "ipdr_long": "+911", "abcdefgh": "+912"}
    index = spark.createDataFrame([(1, "phone", "9876543210"), (2, "handle", "a@b")], "doc_id long, kind string, value string")
    asked = spark.createDataFrame([("+91 98765 43210",), ("A@B",), ("zzz",)], "value string")
    assert {(r.asked, r.doc_id) for r in normalise.find_mentions(index, asked).collect()} == {("+91 98765 43210", 1), ("A@B", 2)}


def test_mentions_one_sign_apart(spark):
    from tracewell.functions import scalars

    text = "9876543210 9876543211 9876543212, 10.0.0.1 10.0.0.2;1.2.3.4.5 119876543210"
    got = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in scalars.mentions(F.col("t")).items())).first()
    assert got.phones == ["9876543210", "9876543211", "9876543212"] and got.ips == ["10.0.0.1", "10.0.0.2"] and got.devices == []


def test_rupees_by_any_name(spark):
    from tracewell.functions import scalars

    rows = [("Rs",), ("rupees",), ("INR.",), (" inr ",), (None,), ("btc",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(scalars.asset(F.col("c"))).collect()]
    assert got == ["INR"] * 5 + ["CRYPTO:BTC"]


def test_sessions_of_other_addresses_are_others(spark):
    from tracewell.operators import ledger

    t = "2024-01-01 10:00:00"
    rows = [(1, "IP_SESSION", 5, t, t, "1.1.1.1", 80), (2, "IP_SESSION", 5, t, t, "1.1.1.1", 81), (3, "IP_SESSION", 5, t, t, None, 80), (4, "IP_SESSION", 5, t, t, "-", 80), (5, "IP_SESSION", 5, t, t, "1.1.1.1", 80)]
    e = spark.createDataFrame(rows, "event_id long, event_type string, entity_id long, ts_start string, ts_end string, public_ip string, port int")
    blank = {c: F.lit(None).cast("string") for c in ("counterparty_entity_id", "amount", "direction", "ref_no", "duration")}
    assert sorted(r.event_id for r in ledger.dedupe(e.withColumns(blank)).collect()) == [1, 2, 3, 4]
