"""Differences between two copies of a dataset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import values as V
from tallywright.operators.merge import key_window, newest, range_sorted

RECORD = "<record>"


def _meant(value: Column, kind: Column) -> Column:
    """A value in the one notation of its kind; what can't be read as its kind stays text."""
    text = V.folded(value)
    return F.coalesce(
        F.when(kind == "date", V.calendar_date(value).cast("string"))
        .when(kind == "number", V.amount(value).cast("string"))
        .when(kind == "boolean", V.truth(value).cast("string")),
        text,
    )


def diff_copies(
    df: DataFrame,
    keys: list[str],
    side: str = "side",
    fields: str = "fields",
    version: tuple[str, ...] = ("projected_at", "row_id"),
    kinds: Mapping[str, str] | None = None,
    sides: tuple[str, str] = ("a", "b"),
) -> DataFrame:
    """Rows (keys, field_name, status) where the two copies of a record differ.

    df holds both copies; `side` tells them apart, `fields` is a map<string,string>. Of the rows of
    one side and key the one with the greatest version counts. kinds: "date", "number" or "boolean"
    by field name; fields without a kind are texts.

    status: missing-in-<side> with field_name <record> if only one side has the key; null-in-<side>
    if only that side's value is blank (absent, null or white space); mismatch if both have a value
    and these differ by meaning. Texts are compared without regard to case, outer and repeated white
    space and Unicode composition.

    Both copies are range-partitioned together, so they share their split points, sorted within
    partitions by key and side, and merged in one pass over neighbouring rows.

    Defined cases: a null key is a key like others; rows of no known side are left out; a null or
    empty map has no values; ties are settled by the last version column; an empty table gives no
    rows; further columns are ignored.
    """
    a, b = sides
    own = df.select(*[F.col(k) for k in keys], F.col(side).alias("_side"), F.col(fields).alias("_fields"), *[F.col(v).alias(f"_v{n}") for n, v in enumerate(version)])
    own = own.where(F.col("_side").isin(a, b))
    once = newest(own, [*keys, "_side"], [f"_v{n}" for n in range(len(version))], ["_fields"])
    window = key_window(keys, ["_side"])
    near = range_sorted(once, keys, ["_side"]).withColumns({"_next": F.lead("_side").over(window), "_other": F.lead("_fields").over(window), "_before": F.lag("_side").over(window)})
    first, second = sorted(sides)
    alone = F.when(F.col("_side") == first, F.col("_next").isNull()).otherwise(F.col("_before").isNull())
    none = F.create_map().cast("map<string,string>")
    # most values are the same text on both sides: they go while they are entries of the maps, before they become rows
    entry = "array<struct<key:string,value:struct<x:string,y:string>>>"
    both = F.map_entries(F.map_zip_with(F.coalesce("_fields", none), F.coalesce("_other", none), lambda k, x, y: F.struct(x.alias("x"), y.alias("y"))))
    unequal = F.filter(both, lambda e: ~e["value"]["x"].eqNullSafe(e["value"]["y"]))
    record = F.array(F.struct(F.lit(RECORD).alias("key"), F.struct(F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y")).alias("value")))
    # a lone record gives one entry, a pair one for each field, the pair's second row none
    entries = F.when(alone, record.cast(entry)).when(F.col("_side") == first, unequal.cast(entry))
    kind = F.lit("text")
    for k in ("date", "number", "boolean"):
        if own_names := [n for n, of in (kinds or {}).items() if of == k]:
            kind = F.when(F.col("field_name").isin(own_names), F.lit(k)).otherwise(kind)
    lone = F.col("_lone")
    x, y = ("x", "y") if first == a else ("y", "x")
    pairs = near.select(*keys, "_side", alone.alias("_lone"), F.explode(entries).alias("_e"))
    pairs = pairs.select(*keys, "_side", "_lone", F.col("_e.key").alias("field_name"), F.col(f"_e.value.{x}").alias("_x"), F.col(f"_e.value.{y}").alias("_y"))
    pairs = pairs.withColumns({"_kind": kind, "_bx": V.is_blank(F.col("_x")), "_by": V.is_blank(F.col("_y"))}).where(lone | ~(F.col("_bx") & F.col("_by")))
    one_blank = F.col("_bx") | F.col("_by")
    pairs = pairs.withColumns({"_mx": F.when(~one_blank, _meant(F.col("_x"), F.col("_kind"))), "_my": F.when(~one_blank, _meant(F.col("_y"), F.col("_kind")))})
    pairs = pairs.where(lone | one_blank | (F.col("_mx") != F.col("_my")))
    # Unicode composition needs Python; of the pairs that still differ only those beyond ASCII are sent there
    beyond = ~(V.is_ascii(F.col("_mx")) & V.is_ascii(F.col("_my")))
    pairs = pairs.where(~V.same_composed(F.when(beyond, F.col("_mx")), F.when(beyond, F.col("_my"))))
    status = (
        F.when(lone & (F.col("_side") == a), F.lit(f"missing-in-{b}"))
        .when(lone, F.lit(f"missing-in-{a}"))
        .when(F.col("_bx"), F.lit(f"null-in-{a}"))
        .when(F.col("_by"), F.lit(f"null-in-{b}"))
        .otherwise(F.lit("mismatch"))
    )
    return pairs.select(*keys, "field_name", status.alias("status"))
