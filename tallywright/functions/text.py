"""Redaction of personal data, check digits, stable hashes of nested values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is redacted, in the order in which it is.
PII = (
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("PHONE", r"(?:\+44|0)[\s-]?\d[\s-]?(?:\d[\s-]?){8,9}"),
    ("NHS_NUMBER", r"\b\d{3}[\s-]?\d{3}[\s-]?\d{4}\b"),
    ("POSTCODE", r"(?i)\b[A-Z]{1,2}\d[\d A-Z]?\s?\d[A-Z]{2}\b"),
    ("NI_NUMBER", r"(?i)\b[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\d{6}[A-D ]{1}\b"),
    ("PASSPORT", r"\b[A-Z]{1,3}\d{7}\b"),
)
MOD11_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 0, 0)


def redact(c: Column) -> Column:
    """Text with personal data replaced by [KIND]."""
    for kind, pattern in PII:
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return c


def check_digit(c: Column) -> Column:
    """The check digit of a 13-digit number: 11 minus the weighted sum of the first twelve modulo 11; null for 10 and for what isn't 13 digits."""
    digits = F.transform(F.filter(F.split(F.substring(c, 1, 12), ""), lambda x: x != ""), lambda x: x.cast("int"))
    total = F.aggregate(F.zip_with(digits, F.array(*map(F.lit, MOD11_WEIGHTS)), lambda a, b: a * b), F.lit(0), lambda acc, x: acc + x)
    digit = (11 - total % 11) % 11
    return F.when(c.rlike(r"^\d{13}$") & (digit != 10), digit)


def digest(*parts: Column) -> Column:
    """SHA-256 of values in their order; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{n}") for n, p in enumerate(parts)])), 256)


def stable_json(m: Column) -> Column:
    """A map of texts as JSON with its keys in order, so that equal maps give equal texts; an empty object for null."""
    entries = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
