"""GTIN and part-number keys, as column expressions. Invalid or missing input gives an empty key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\D+", "")


def gtin_valid(digits: Column) -> Column:
    """8, 12, 13 or 14 digits, not all zero, with a right GS1 check digit."""
    padded = F.lpad(digits, 14, "0")
    total = F.lit(0)
    for k in range(14):
        total = total + F.substring(padded, k + 1, 1).cast("int") * (3 if k % 2 == 0 else 1)
    shaped = digits.rlike("^(?:[0-9]{8}|[0-9]{12,14})$") & digits.rlike("[1-9]")
    return F.when(shaped, total % 10 == 0).otherwise(False)


def gtin(raw: Column) -> Column:
    """struct(gtin14, valid, trusted, related_unit)."""
    digits = digits_of(raw)
    valid = gtin_valid(digits)
    key = F.when(valid, F.lpad(digits, 14, "0")).otherwise("")
    related = key.rlike("^[1-8]")
    trusted = valid & ~related & ~key.rlike("^.(?:2|02|04)")
    return F.struct(key.alias("gtin14"), valid.alias("valid"), trusted.alias("trusted"), related.alias("related_unit"))


def _strict(value: Column) -> Column:
    key = F.regexp_replace(F.upper(value), r"(?U)[\s\-/.]+", "")
    bare = F.ltrim(key, F.lit("0"))
    return F.when(F.length(bare) >= 4, bare).otherwise(key)


def stripped(c: Column) -> Column:
    """Without white space at both ends, of any kind; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def mpn(raw: Column) -> Column:
    """struct(strict, loose): upper case, separators dropped, leading zeros dropped where four
    characters stay; loose ends before the last hyphen."""
    value = stripped(raw)
    head = F.regexp_extract(value, r"(?s)^(.*)-", 1)
    strict = _strict(value)
    loose = F.when(value.contains("-") & (stripped(head) != ""), _strict(head)).otherwise(strict)
    return F.struct(strict.alias("strict"), loose.alias("loose"))
