"""History of changing attributes: versions with the periods in which they held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.merge import newest


def change_log(df: DataFrame, key: str, start: str, attributes: list[str], end: str | None = None) -> DataFrame:
    """The event log (key, at, attribute, held): a row wherever an attribute takes another value or ends.

    df has one row per key and start. Without `end` a row holds until the key's next one. With it, a
    row holds until its end or the next row's start, whichever is earlier, and where a row ends
    before the next one starts, every attribute ends. held is a struct of the value, so that a null
    value (struct of null) differs from no value (null).
    """
    window = Window.partitionBy(key).orderBy(start)
    after, before = F.lead(start).over(window), F.lag(start).over(window)
    rows = df.withColumns({"_next": after, "_first": before.isNull(), **{f"_was{n}": F.lag(a).over(window) for n, a in enumerate(attributes)}})
    if end:
        rows = rows.withColumn("_end", F.when(F.col("_next").isNull() | (F.col(end) < F.col("_next")), F.col(end)))
        # the row starts anew after a gap, though its value may be the one before
        rows = rows.withColumn("_first", F.col("_first") | F.lag(F.col("_end").isNotNull(), 1, False).over(window))
    else:
        rows = rows.withColumn("_end", F.lit(None).cast(dict(df.dtypes)[start]))
    held = "struct<value:string>"
    began = [
        F.when(F.col("_first") | ~F.col(a).eqNullSafe(F.col(f"_was{n}")), F.struct(F.col(start).alias("at"), F.lit(n).alias("attribute"), F.struct(F.col(a).cast("string").alias("value")).alias("held")))
        for n, a in enumerate(attributes)
    ]
    ended = [F.when(F.col("_end").isNotNull(), F.struct(F.col("_end").alias("at"), F.lit(n).alias("attribute"), F.lit(None).cast(held).alias("held"))) for n in range(len(attributes))]
    events = F.filter(F.array(*began, *(ended if end else [])), lambda x: x.isNotNull())
    return rows.select(key, F.explode(events).alias("_e")).select(key, "_e.*")


def combine_log(log: DataFrame, key: str, attributes: list[str], forever: Column) -> DataFrame:
    """Versions (key, valid_from, valid_to, attributes) out of a change log.

    The attributes' intervals are split at the union of their boundaries: a version at each boundary,
    with the values that hold there. As every boundary is one where some attribute changes or ends,
    neighbouring versions differ or have a gap between them. Periods are half open.
    """
    # of two events of an attribute at one boundary the one that begins counts
    at_boundary = log.groupBy(key, "at").agg(*[F.max(F.when(F.col("attribute") == n, F.struct(F.col("held").isNotNull().alias("alive"), F.col("held").alias("held")))).alias(f"_a{n}") for n in range(len(attributes))])
    window = Window.partitionBy(key).orderBy("at")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    filled = at_boundary.select(key, "at", F.lead("at").over(window).alias("_to"), *[F.last(f"_a{n}", ignorenulls=True).over(upto).alias(f"_a{n}") for n in range(len(attributes))])
    alive = filled.where(F.col("_a0.alive"))
    return alive.select(key, F.col("at").alias("valid_from"), F.coalesce(F.col("_to"), forever).alias("valid_to"), *[F.col(f"_a{n}.held.value").alias(a) for n, a in enumerate(attributes)])


def history(
    df: DataFrame,
    key: str,
    start: str,
    attributes: list[str],
    version: list[Column | str],
    forever: Column,
    end: str | None = None,
) -> DataFrame:
    """Every version of every key with its half-open period, from snapshots or updates.

    Of rows with one key and start the one with the greatest version counts (reduced on the map
    side, so that a key with many rows is no burden); what is left goes through change_log() and
    combine_log(), which share one exchange by key.

    Defined cases: rows with a null key or start are left out; null values are equal to each other;
    unchanged re-entries make no version; with `end`, a row without end holds to `forever`, one that
    does not end after its start is left out; an empty table gives no rows; further columns are
    ignored.
    """
    own = df.select(F.col(key).alias("_key"), F.col(start).alias("_start"), *([F.coalesce(F.col(end), forever).alias("_until")] if end else []), *[F.col(a).alias(f"_x{n}") for n, a in enumerate(attributes)], *[(v if isinstance(v, Column) else F.col(v)).alias(f"_v{n}") for n, v in enumerate(version)])
    own = own.where(F.col("_key").isNotNull() & F.col("_start").isNotNull())
    if end:
        own = own.where(F.col("_until") > F.col("_start"))
    values = [f"_x{n}" for n in range(len(attributes))]
    once = newest(own, ["_key", "_start"], [f"_v{n}" for n in range(len(version))], [*values, *(["_until"] if end else [])])
    log = change_log(once, "_key", "_start", values, "_until" if end else None)
    out = combine_log(log, "_key", values, forever)
    return out.where(F.col("valid_from") < forever).select(F.col("_key").alias(key), "valid_from", "valid_to", *[F.col(v).alias(a) for v, a in zip(values, attributes, strict=True)])
