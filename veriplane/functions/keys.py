"""Join keys and normal forms of phones, addresses, dates and pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def phone_key(raw: Column) -> Column:
    """The last ten digits; null if there are fewer."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def address_key(line: Column, city: Column, state: Column, postal: Column) -> Column:
    """Upper-case letters and digits of the parts with a five-digit ZIP code; null if nothing is left."""
    zip5 = F.substring(F.regexp_replace(F.coalesce(postal, F.lit("")), "[^0-9]", ""), 1, 5)
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (line, city, state)], zip5)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.upper(joined), "[^A-Z0-9 ]", " "), " +", " ")), F.lit(""))


def first_npi(field: Column) -> Column:
    return F.nullif(F.regexp_extract(field, r"\b[0-9]{10}\b", 0), F.lit(""))


def rfc3339_or_us_date(raw: Column) -> Column:
    """A timestamp from RFC 3339 text (time and offset required), m/d/yy or m/d/yyyy; two digits mean 1970-2069; else null."""
    full = F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}.*([Zz]|[+-][0-9]{2}:[0-9]{2})$"), F.upper(raw)).try_cast("timestamp")
    parts = F.split(F.regexp_extract(raw, r"^([0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2}))$", 1), "/")
    y = F.try_element_at(parts, F.lit(3)).try_cast("int")
    year = F.when(F.length(F.try_element_at(parts, F.lit(3))) == 2, y + F.when(y >= 70, 1900).otherwise(2000)).otherwise(y)
    date = F.try_to_timestamp(F.format_string("%04d-%s-%s", year, F.lpad(parts[0], 2, "0"), F.lpad(F.get(parts, 1), 2, "0")), F.lit("yyyy-MM-dd"))
    return F.coalesce(full, F.when(year.isNotNull(), date))


def short_hash(*parts: Column) -> Column:
    """First 16 bytes, in hex, of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 32)


def pair_of(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the bytes of a text."""
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    octets = F.when(F.length(digits) > 0, F.transform(places, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("long")))
    mask = F.lit(0xFFFFFFFF).cast("long")
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(mask)
    start = F.lit(2166136261).cast("long")
    return F.when(text.isNotNull(), F.aggregate(F.coalesce(octets, F.array().cast("array<bigint>")), start, step))
