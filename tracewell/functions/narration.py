"""Identifiers that bank narrations hold, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words of narrations.
PATTERNS = {"upi_id": "([a-zA-Z0-9.\\-_]{2,}@[a-zA-Z]{2,})", "utr": "\\b([0-9]{12,22})\\b", "mode": "\\b(UPI|NEFT|IMPS|RTGS|ATM|POS|CASH)\\b"}
HANDLE_PHONE = "(?<![0-9])([6-9][0-9]{9})@[a-zA-Z]{2,}"
HANDLE_ACCOUNT = "(?<![0-9])([0-9]{9,18})@[a-zA-Z]{2,}"
NAME = "\\b([A-Za-z][A-Za-z .]{3,40}[A-Za-z])\\b"
NO_NAMES = ["upi", "neft", "imps", "rtgs", "atm", "pos", "cash", "ref", "the", "and"]


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def mine(c: Column) -> Column:
    """struct<upi_id, utr, mode, phone, account, name>. A handle of an Indian mobile number is a phone, another number an
    account; the name is the longest run of letters that is no mode word, of equally long ones the first, else the last
    part but one of three or more between slashes."""
    phone = _first(c, HANDLE_PHONE)
    names = F.filter(F.transform(F.regexp_extract_all(c, F.lit(NAME), 1), F.trim), lambda n: ~F.lower(n).isin(*NO_NAMES) & (F.length(n) >= 4))
    best = F.array_max(F.transform(names, lambda n, i: F.struct(F.length(n).alias("size"), (-i).alias("place"), n.alias("name"))))["name"]
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    part = F.when(F.size(parts) >= 3, F.trim(F.get(parts, F.greatest(F.size(parts) - 2, F.lit(0)))))
    return F.struct(*(_first(c, p).alias(k) for k, p in PATTERNS.items()), phone.alias("phone"), F.when(phone.isNull(), _first(c, HANDLE_ACCOUNT)).alias("account"), F.coalesce(best, part).alias("name"))
