"""Validation of records against canonical schemas: which fields are missing, and which don't have the form of their kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.values import is_blank

#: The forms of kinds that are texts.
FORMS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "husid": r"^\d{13}$",
    "hecos": r"^\d{6}$",
    "year": r"^\d{4}-\d{2}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
}
#: Fields and kinds of some entities; ? marks a field that may be missing.
SCHEMAS = {
    "Student": "id uuid, sourceId text, husid husid?, firstName text, lastName text, middleNames text?, dateOfBirth date, genderId text?, nationality text?, domicile text?, email email?",
    "Engagement": "id uuid, sourceId text, studentId uuid, startDate date, endDate date?, reasonForEnding text?",
    "Module": "id uuid, sourceId text, code text, title text, credits number?, level text?, hecosCode hecos?",
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    optional: bool


def schema(text: str) -> list[Field]:
    """The fields of a schema written as `name kind, name kind?`; kinds are text, number, integer, boolean and those of FORMS."""
    out = []
    for part in text.split(","):
        name, kind = part.split()
        field = Field(name, kind.rstrip("?"), kind.endswith("?"))
        if field.kind not in ("text", "number", "integer", "boolean", *FORMS):
            raise ValueError(f"unknown kind: {field.kind}")
        out.append(field)
    return out


def _malformed(c: Column, kind: str) -> Column:
    tests: dict[str, Callable[[Column], Column]] = {
        "number": lambda x: x.try_cast("double").isNull(), "integer": lambda x: ~x.rlike(r"^[+-]?\d+$"), "boolean": lambda x: ~F.lower(x).isin("true", "false"), "text": lambda x: F.lit(False),
    }
    return tests[kind](c) if kind in tests else ~c.rlike(FORMS[kind])


def validate(df: DataFrame, key: str, fields: list[Field], columns: dict[str, str] | None = None) -> DataFrame:
    """Rows (key, field, problem), problem missing or malformed, in one scan without a shuffle.

    columns: df's column by field, where it isn't called the same; a field without a column is missing
    in every row. Null, empty and white space are no value: an optional field may have none.
    """
    lower = {c.lower(): c for c in df.columns}
    problems = []
    for f in fields:
        own = lower.get((columns or {}).get(f.name, f.name).lower())
        c = F.col(own).cast("string") if own else F.lit(None).cast("string")
        missing = F.lit(None).cast("string") if f.optional else F.lit("missing")
        found = F.when(is_blank(c), missing).when(_malformed(c, f.kind), F.lit("malformed"))
        problems.append(F.when(found.isNotNull(), F.struct(F.lit(f.name).alias("field"), found.alias("problem"))))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*problems))).alias("_p")).select(key, "_p.*")


def derive(df: DataFrame, derivations: dict[str, str]) -> DataFrame:
    """df with columns from SQL expressions over its own columns, such as CASE texts of a mapping, in their order; a later one may use an earlier one."""
    for name, text in derivations.items():
        df = df.withColumn(name, F.expr(text))
    return df


def coerced(df: DataFrame) -> DataFrame:
    """df with every column as text: nested values as JSON, nulls as they are."""
    nested = lambda kind: kind.startswith(("array", "map", "struct"))
    return df.select(*[(F.to_json(F.col(f"`{c}`")) if nested(kind) else F.col(f"`{c}`").cast("string")).alias(c) for c, kind in df.dtypes])
