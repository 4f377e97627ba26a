"""Cleaning functions for identifiers, amounts and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First digit (zero) of each decimal script that exports use, besides ASCII.
ZEROS = [0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xFF10]


def ascii_digits(c: Column) -> Column:
    """Digits of other scripts as 0 to 9."""
    return F.translate(c.cast("string"), "".join(chr(z + i) for z in ZEROS for i in range(10)), "0123456789" * len(ZEROS))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(ascii_digits(c), "[^0-9]", "")


def phone(c: Column, prefix: str = "+91") -> Column:
    """E.164: a national number of ten digits gets the prefix, longer ones a plus; shorter ones are none."""
    d = digits_only(c)
    d = F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat(F.lit(prefix), d)).when(F.length(d) > 10, F.concat(F.lit("+"), d))


def phone_key(c: Column) -> Column:
    """The last ten digits of ten or more, for comparing numbers written in different forms."""
    d = digits_only(c)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


def header(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def clean_ip(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def account(c: Column) -> Column:
    """The first line, without leading dashes and colons; null if nothing is left."""
    first = F.trim(F.split(F.trim(c), "\n")[0])
    return F.nullif(F.trim(F.regexp_replace(first, "^[-:]+\\s*", "")), F.lit(""))


def amount(c: Column) -> Column:
    """A number from text with currency signs, separators and a trailing /-; parentheses or a minus mean less than zero."""
    s = F.regexp_replace(F.upper(F.trim(ascii_digits(c))), "(INR|RS|USD|₹|\\$)\\.?", "")
    s = F.regexp_replace(F.regexp_replace(s, "/-$", ""), "[,\\s]", "")
    neg = s.rlike("^\\(.*\\)$")
    s = F.regexp_replace(s, "[()]", "")
    v = F.when(s.rlike("^[+-]?[0-9]+(\\.[0-9]+)?$"), s.try_cast("double"))
    return F.when(neg, -v).otherwise(v)


def device_id(c: Column) -> Column:
    d = digits_only(c)
    return F.when(F.length(d) >= 14, d)


#: Accepted date forms, day first unless ISO, in the order tried; a time alone is none.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy", "dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy", "ddMMMyyyy:HH:mm:ss", "ddMMMyyyy", "yyyyMMdd"]


def timestamp(c: Column, source_tz: str = "Asia/Kolkata", zone: str = "Asia/Kolkata") -> Column:
    """A zone-free timestamp in `zone` from text in any of FORMATS; null where none fits."""
    s = F.trim(ascii_digits(c))
    s = F.regexp_replace(s, "(?i)\\b([0-9]{1,2}-?)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(-?[0-9]{4})", "$1$2$3")
    s = F.when(s.rlike("[A-Za-z]{3}"), F.concat(F.regexp_extract(s, "^([^A-Za-z]*)", 1), F.initcap(F.regexp_extract(s, "([A-Za-z]{3})", 1)), F.regexp_extract(s, "[A-Za-z]{3}(.*)$", 1))).otherwise(s)
    t = F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in FORMATS)).cast("timestamp_ntz")
    return t if source_tz == zone else F.convert_timezone(F.lit(source_tz), F.lit(zone), t)


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.trim(ascii_digits(c)), "^['\"]+|['\"]+$", "")


def _clock(time: Column) -> Column:
    """Seconds of a day from HH:MM[:SS], hhmmss, hmmss, hhmm or hmm; 0 for anything else."""
    t = _unquoted(time)
    d = F.regexp_replace(t, "[^0-9]", "")
    six = F.when(F.length(d).isin(5, 6), F.lpad(d, 6, "0")).when(F.length(d).isin(3, 4), F.concat(F.lpad(d, 4, "0"), F.lit("00")))
    parts = F.split(t, ":")
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit("0"))
    h, m, s = (F.when(t.contains(":"), at(i)).otherwise(F.substring(six, 2 * i + 1, 2)).try_cast("int") for i in range(3))
    return F.coalesce(F.when(h.between(0, 23) & m.between(0, 59) & s.between(0, 59), h * 3600 + m * 60 + s), F.lit(0))


def _day(date: Column) -> Column:
    """A date's text without quotes or a clock behind it."""
    return F.regexp_replace(_unquoted(date), r"[\sT:]+[0-9]{1,2}:[0-9]{2}.*$", "")


def _plus(at: Column, seconds: Column) -> Column:
    return (at + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def date_time(date: Column, time: Column, source_tz: str = "Asia/Kolkata", zone: str = "Asia/Kolkata") -> Column:
    """A zone-free timestamp from a date and a time in columns of their own: HH:MM[:SS], hhmmss, hmmss, hhmm or hmm. A time
    that is none, or none at all, is midnight; without a date there is nothing."""
    local = _plus(timestamp(_day(date)), _clock(time))
    return local if source_tz == zone else F.convert_timezone(F.lit(source_tz), F.lit(zone), local)


def event_time(datetime_col: Column, timestamp_start: Column, date_col: Column, time_col: Column, source_tz: str = "Asia/Kolkata", zone: str = "Asia/Kolkata") -> Column:
    """When something happened: the first of a full column, a start, or a date with a time, that is filled at all. One that
    is filled but can't be read gives null, not the next."""
    there = lambda c: F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))
    full = F.when(there(datetime_col), datetime_col).when(there(timestamp_start), timestamp_start)
    local = _plus(timestamp(F.coalesce(full, _day(date_col))), F.when(full.isNull(), _clock(time_col)).otherwise(0))
    return local if source_tz == zone else F.convert_timezone(F.lit(source_tz), F.lit(zone), local)


def call_direction(c: Column) -> Column:
    """OUT words go before IN words, since a word such as ROAMING holds IN; OUT where neither stands."""
    u = F.upper(c)
    return F.when(u.rlike("MOC|SMS-O|OUT"), "OUT").when(u.rlike("MTC|SMS-T|IN"), "IN").otherwise("OUT")


def bank_movement(debit: Column, credit: Column, signed: Column) -> Column:
    """struct<amount, direction>: a non-zero debit, else a non-zero credit, else the signed amount, where zero is a credit."""
    d, c, s = amount(debit), amount(credit), amount(signed)
    pair = lambda a, w: F.struct(F.abs(a).alias("amount"), F.lit(w).alias("direction"))
    return F.when(F.coalesce(d, F.lit(0.0)) != 0, pair(d, "DEBIT")).when(F.coalesce(c, F.lit(0.0)) != 0, pair(c, "CREDIT")).when(s < 0, pair(s, "DEBIT")).when(s.isNotNull(), pair(s, "CREDIT"))


# Names of the rupee in currency columns.
RUPEES = ["INR", "INR.", "RS", "RS.", "RUPEE", "RUPEES", "₹"]


def asset(currency: Column) -> Column:
    u = F.upper(F.trim(currency))
    return F.when(u.isNull() | u.isin("", *RUPEES), "INR").otherwise(F.concat(F.lit("CRYPTO:"), u))


def number_in_name(file: Column) -> Column:
    """The first lone run of ten digits that begins with 6 to 9 in a file's name; null without one."""
    return F.nullif(F.regexp_extract(file, "(?<![0-9])([6-9][0-9]{9})(?![0-9])", 1), F.lit(""))


def payment_handles(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([A-Za-z0-9._-]{2,}@[A-Za-z]{2,})"), 1)))


#: Identifiers that documents mention, by pattern; each value once, sorted.
MENTIONS = {
    "phones": "(?<![0-9])([6-9][0-9]{9})(?![0-9])",
    "devices": "(?<![0-9])([0-9]{15,16})(?![0-9])",
    "handles": "([A-Za-z0-9._-]{2,}@[A-Za-z]{2,})",
    "ips": "(?<![0-9.])([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})(?![0-9.])",
}


# What documents say of accounts, branches and subscribers, by the label before them where one is needed.
LABELLED = {
    "accounts": r"(?i)(?:A/?C(?:\s*No)?|ACCOUNT\s*(?:NO|NUMBER)?|એકાઉન્ટ\s*નં|ખાતા\s*નં|બેંક\s*એકાઉન્ટ)[\s.:#–-]*([0-9]{9,18})",
    "branches": r"(?<![A-Za-z0-9_])([A-Z]{4}0[A-Z0-9]{6})(?![A-Za-z0-9_])",
    "subscribers": r"(?i)IMSI[^0-9]{0,12}([0-9]{15})",
    "handsets": r"(?i)(?<!\p{L})IMEI(?:S|NO|NUMBER)?(?!\p{L})[^0-9]{0,12}((?:[0-9][0-9/\s,]{13,60}))",
}


def labelled_mentions(c: Column) -> dict[str, Column]:
    """Identifiers beside their labels, each once, sorted. Devices are kept if they have 14 to 16 digits, however parted;
    signs within a longer word are no label of theirs."""
    c = ascii_digits(c)
    found = {k: F.regexp_extract_all(c, F.lit(p), 1) for k, p in LABELLED.items()}
    found["handsets"] = F.filter(F.transform(found["handsets"], lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: F.length(x).between(14, 16))
    return {k: F.array_sort(F.array_distinct(v)) for k, v in found.items()}


def mentions(c: Column) -> dict[str, Column]:
    return {k: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(p), 1))) for k, p in MENTIONS.items()}


def ipv6_prefix(c: Column) -> Column:
    """The first four groups of an IPv6 address in full form, with ::/64; null for others."""
    halves = F.split(F.lower(F.trim(c)), "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    head, tail = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0)))
    full = F.when(F.size(halves) > 1, F.concat(head, gap, tail)).otherwise(head)
    bare = F.transform(F.slice(full, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return F.when(c.contains(":") & (F.size(full) == 8), F.concat(F.array_join(bare, ":"), F.lit("::/64")))
