"""Mapped rows of each kind of source as canonical events, and what is known of their identifiers.

An identifier is a struct<id_type, id_value>. Every function keeps all rows; `reason` says why one is no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import narration, scalars


def ident(kind: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("id_type"), value.alias("id_value")))


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _reason(ts: Column, who: Column) -> Column:
    return F.when(ts.isNull(), "no timestamp").when(who.isNull(), "timestamp but no identifier")


def _when(rows: DataFrame, source_tz: str = "Asia/Kolkata") -> Column:
    """A row's time: `datetime_col`, `when` (or `timestamp_start`), or `date_col` and `time_col`, the first that is filled."""
    c = lambda n: _column(rows, n)
    start = F.coalesce(F.nullif(F.trim(c("when")), F.lit("")), c("timestamp_start"))
    return scalars.event_time(c("datetime_col"), start, c("date_col"), c("time_col"), source_tz)


def bank(rows: DataFrame) -> DataFrame:
    """rows: when, account_no, header_account, registered_mobile, narration, debit, credit, amount, balance, ref_no,
    currency. The header's mobile belongs to a row only if the row's account is the header's."""
    c = lambda n: _column(rows, n)
    ts, account, header = _when(rows), F.coalesce(scalars.account(c("account_no")), scalars.account(c("header_account"))), scalars.account(c("header_account"))
    said, move = narration.mine(c("narration")), scalars.bank_movement(c("debit"), c("credit"), c("amount"))
    mobile = F.when(account == header, scalars.phone(c("registered_mobile")))
    out = rows.withColumns({"_said": said, "_move": move, "_ts": ts, "_account": account, "_mobile": mobile})
    other = F.coalesce(ident("PHONE", scalars.phone(F.col("_said.phone"))), ident("ACCOUNT_NO", F.col("_said.account")), ident("UPI_ID", F.col("_said.upi_id")), ident("BENEFICIARY", F.col("_said.name")))
    return out.select(F.lit("TRANSACTION").alias("event_type"), F.col("_ts").alias("ts_start"), F.lit(None).cast("timestamp_ntz").alias("ts_end"), F.col("_move.amount").alias("amount"), F.col("_move.direction").alias("direction"), scalars.asset(c("currency")).alias("asset"), ident("ACCOUNT_NO", F.col("_account")).alias("primary_id"), other.alias("counterparty_id"), F.array_compact(F.array(ident("ACCOUNT_NO", F.col("_account")), ident("PHONE", F.col("_mobile")))).alias("own_ids"), c("ref_no").alias("ref_no"), scalars.amount(c("balance")).alias("balance"), F.col("_said.mode").alias("mode"), _reason(F.col("_ts"), F.col("_account")).alias("reason"))


def calls(rows: DataFrame) -> DataFrame:
    """rows: when, a_party, b_party, duration, call_type, imei, imsi, target, source_file. Devices belong to the caller
    only where it is the report's target, named by a column or by the file."""
    c = lambda n: _column(rows, n)
    rows = rows.withColumns({"_ts": _when(rows), "_a": scalars.phone(c("a_party"))})  # read once
    ts, a = F.col("_ts"), F.col("_a")
    seconds = F.floor(F.trim(c("duration")).try_cast("double")).cast("long")
    subject = F.coalesce(scalars.phone(c("target")), scalars.phone(scalars.number_in_name(c("source_file"))))
    own = lambda k, v: F.when(subject == a, ident(k, scalars.device_id(v)))
    end = F.when(seconds != 0, ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    return rows.select(F.lit("CALL").alias("event_type"), ts.alias("ts_start"), end.alias("ts_end"), F.lit(None).cast("double").alias("amount"), scalars.call_direction(c("call_type")).alias("direction"), F.lit(None).cast("string").alias("asset"), ident("PHONE", a).alias("primary_id"), ident("PHONE", scalars.phone(c("b_party"))).alias("counterparty_id"), F.array_compact(F.array(ident("PHONE", a), own("IMEI", c("imei")), own("IMSI", c("imsi")))).alias("own_ids"), seconds.alias("duration"), _reason(ts, a).alias("reason"))


def sessions(rows: DataFrame) -> DataFrame:
    """rows: when, until, subscriber, public_ip, private_ip, imei, imsi, source_file, source_tz by column order of use:
    the subscriber, else the number in the file's name; the session is a phone's, else its public, else private address's."""
    c = lambda n: _column(rows, n)
    rows = rows.withColumn("_ts", _when(rows))
    ts = F.col("_ts")
    who = F.coalesce(scalars.phone(c("subscriber")), scalars.phone(scalars.number_in_name(c("source_file"))))
    pub, priv = scalars.clean_ip(c("public_ip")), scalars.clean_ip(c("private_ip"))
    first = F.coalesce(ident("PHONE", who), ident("IP", pub), ident("IP", priv))
    own = F.array_compact(F.array(ident("PHONE", who), ident("IP", F.coalesce(pub, priv)), ident("IMEI", scalars.device_id(c("imei"))), ident("IMSI", scalars.device_id(c("imsi")))))
    return rows.select(F.lit("IP_SESSION").alias("event_type"), ts.alias("ts_start"), scalars.timestamp(c("until")).alias("ts_end"), first.alias("primary_id"), own.alias("own_ids"), pub.alias("public_ip"), priv.alias("private_ip"), who.alias("phone"), _reason(ts, first).alias("reason"))


def crypto(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows: when (UTC), from_addr, to_addr, amount, token, txn_hash; rates: token, inr. Always a debit of the sender."""
    c = lambda n: _column(rows, n)
    ts, a, b = _when(rows, "UTC"), F.nullif(F.trim(c("from_addr")), F.lit("")), F.nullif(F.trim(c("to_addr")), F.lit(""))
    token, amount = F.coalesce(F.nullif(F.trim(c("token")), F.lit("")), F.lit("CRYPTO")), scalars.amount(c("amount"))
    out = rows.select(F.lit("TRANSACTION").alias("event_type"), ts.alias("ts_start"), amount.alias("amount"), F.lit("DEBIT").alias("direction"), F.concat(F.lit("CRYPTO:"), token).alias("asset"), ident("ACCOUNT_NO", a).alias("primary_id"), ident("ACCOUNT_NO", b).alias("counterparty_id"), c("txn_hash").alias("ref_no"), token.alias("token"), F.when(ts.isNull(), "no timestamp").when(a.isNull() | b.isNull(), "timestamp but no identifier").alias("reason"))
    return out.join(rates, "token", "left").withColumn("value_inr", F.round(F.col("amount") * F.col("inr"), 2)).drop("inr")


def prefix_phones(found: DataFrame) -> DataFrame:
    """Sessions without a phone take that of the first session, by start, on the same IPv6 /64: public before private."""
    s = found.withColumn("_pub", scalars.ipv6_prefix(F.col("public_ip"))).withColumn("_priv", scalars.ipv6_prefix(F.col("private_ip")))
    known = s.where("phone IS NOT NULL").select(F.explode(F.array_compact(F.array("_pub", "_priv"))).alias("_p"), "phone", "ts_start")
    known = known.groupBy("_p").agg(F.min(F.struct("ts_start", "phone"))["phone"].alias("_phone"))
    out = s.join(known.select(F.col("_p").alias("_pub"), F.col("_phone").alias("_a")), "_pub", "left").join(known.select(F.col("_p").alias("_priv"), F.col("_phone").alias("_b")), "_priv", "left")
    new = F.when(F.col("phone").isNull(), F.coalesce("_a", "_b"))
    out = out.withColumn("primary_id", F.coalesce(ident("PHONE", new), F.col("primary_id"))).withColumn("own_ids", F.when(new.isNotNull(), F.concat(F.array(ident("PHONE", new)), F.col("own_ids"))).otherwise(F.col("own_ids"))).withColumn("upgraded", new.isNotNull())
    return out.withColumn("phone", F.coalesce("phone", new)).drop("_pub", "_priv", "_a", "_b")


def reply_pairs(rows: DataFrame, account_col: str, phone_col: str) -> DataFrame:
    """(account, phone): every account number in a row's account cell with every mobile in its phone cell, once."""
    a = F.regexp_extract_all(scalars.ascii_digits(F.col(f"`{account_col}`")), F.lit("(?<![0-9])([0-9]{9,18})(?![0-9])"), 1)
    p = F.regexp_extract_all(scalars.ascii_digits(F.col(f"`{phone_col}`")), F.lit("(?<![0-9])(?:91|0)?([6-9][0-9]{9})(?![0-9])"), 1)
    return rows.select(F.explode(a).alias("account"), p.alias("p")).select("account", F.explode("p").alias("phone")).select("account", scalars.phone(F.col("phone")).alias("phone")).distinct()


def stem_phones(columns: DataFrame, stems: DataFrame) -> DataFrame:
    """(col, phone): a column named like a session file takes its phone: an equal name first, else the first stem, by
    name, that begins the column or that the column is part of. Names meet under their first six signs or, for parts,
    under runs of six; shorter columns match whole names only."""
    c, s = columns.select(F.lower("col").alias("_c"), "col").distinct(), stems.select(F.lower("stem").alias("_s"), "phone")
    exact = c.join(s, F.col("_c") == F.col("_s")).select("col", F.lit(0).alias("how"), "_s", "phone")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_s") - 5, F.lit(1))), lambda i: F.col("_s").substr(i, F.lit(6))))
    met = c.where(F.length("_c") >= 6).withColumn("_k", F.substring("_c", 1, 6)).join(s.withColumn("_k", F.explode(runs)), "_k")
    near = met.where(F.col("_c").startswith(F.col("_s")) | F.col("_s").contains(F.col("_c"))).select("col", F.lit(1).alias("how"), "_s", "phone")
    return exact.unionByName(near).groupBy("col").agg(F.min(F.struct("how", "_s", "phone"))["phone"].alias("phone"))


def find_mentions(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, doc_id, kind): documents that mention an identifier. index: doc_id, kind, value; asked: value. Numbers of
    ten digits or more are compared by their last ten."""
    key = lambda c: F.coalesce(scalars.phone_key(F.when(c.rlike("^[+0-9 -]+$"), c)), F.lower(F.trim(c)))
    i = index.withColumn("_k", key(F.col("value"))).select("_k", "doc_id", "kind").distinct()
    return asked.select(F.col("value").alias("asked"), key(F.col("value")).alias("_k")).join(i, "_k").select("asked", "doc_id", "kind")
