"""Code maps, effective dating, alternate ids and source keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.session import small


def translate(rows: DataFrame, code: str, maps: DataFrame, at: Column | None = None, tenant: Column | None = None, default: str | None = None) -> DataFrame:
    """rows with target and translated_by: the first entry by entry_id whose code matches and that is active at the time, the tenant's before the general ones.

    maps: sourcecode, targetcode, activefrom, activeto, tenantid, entry_id. A period holds its start and
    not its end; open where null. rows must not have those columns. Nothing is lost: a row without
    an entry keeps a null target, or the default.
    """
    # all entries of a code in their order, the tenant's before the general ones: rows are looked up without being moved
    entry = F.struct(F.col("tenantid").isNull().alias("g"), F.col("entry_id").alias("e"), F.col("tenantid").alias("tenant"), F.col("activefrom").alias("f"), F.col("activeto").alias("t"), F.col("targetcode").alias("target"))
    entries = maps.where("sourcecode is not null").groupBy(F.col("sourcecode").alias("_code")).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))

    def holds(e: Column) -> Column:
        match = e["tenant"].isNull() | (e["tenant"].eqNullSafe(tenant) if tenant is not None else F.lit(False))
        if at is not None:
            match = match & (e["f"].isNull() | (e["f"] <= at)) & (e["t"].isNull() | (at < e["t"]))
        return match

    best = F.get(F.filter("_entries", holds), F.lit(0))
    met = rows.join(small(entries), F.col(code) == F.col("_code"), "left").withColumn("_best", best)
    target = F.col("_best.target")
    return met.select(*rows.columns, (F.coalesce(target, F.lit(default)) if default is not None else target).alias("target"), F.col("_best.e").alias("translated_by"))


def coverage(observed: DataFrame, code: str, maps: DataFrame) -> DataFrame:
    """One row: distinct codes seen, mapped, the unmapped in order, and the share mapped (1 where none is seen)."""
    seen = observed.select(F.col(code).alias("c")).where("c is not null").distinct()
    known = maps.select(F.col("sourcecode").alias("c"), F.lit(1).alias("k")).distinct()
    both = seen.join(known, "c", "left")
    return both.agg(F.count(F.lit(1)).alias("observed"), F.count("k").alias("mapped"), F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("k").isNull(), F.col("c"))))).alias("unmapped"), F.coalesce(F.try_divide(F.count("k").cast("double"), F.count(F.lit(1))), F.lit(1.0)).alias("ratio"))


def _first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def as_at(df: DataFrame, key: str, date: str, at: Column, ordinal: str) -> DataFrame:
    """Per key the row with the greatest date not after `at`; undated rows pass; of ties the last by ordinal."""
    return _first(df.where(F.col(date).isNull() | (F.col(date) <= at)), key, [F.col(date).desc_nulls_last(), F.col(ordinal).desc()])


def in_period(df: DataFrame, key: str, start: str, end: str, at: Column, ordinal: str) -> DataFrame:
    """Per key the first row by ordinal with start <= at < end; an absent end is open."""
    return _first(df.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end)))), key, [F.col(ordinal).asc()])


def by_change_indicator(df: DataFrame, key: str, indicator: str, date: str, ordinal: str) -> DataFrame:
    """Per key the newest row whose indicator is blank; undated last; ties by ordinal."""
    return _first(df.where(F.coalesce(F.trim(F.col(indicator)), F.lit("")) == ""), key, [F.col(date).desc_nulls_last(), F.col(ordinal).asc()])


def by_status(df: DataFrame, key: str, active: Column, ordinal: str) -> DataFrame:
    """Per key the first active row by ordinal."""
    return _first(df.where(active), key, [F.col(ordinal).asc()])


def snapshot(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Per key the first row by ordinal."""
    return _first(df, key, [F.col(ordinal).asc()])


def merge_alt_ids(*frames: DataFrame) -> DataFrame:
    """Alternate ids (system, type, value, first_seen, is_current) as one set: value without regard to case, earliest first_seen, current if any is."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("system", "type", F.lower("value").alias("value")).agg(F.min("first_seen").alias("first_seen"), F.max("is_current").alias("is_current"))


def merge_source_keys(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    left, right = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (left, right))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)


def id_index(records: DataFrame, canonical: str, system: str, source_id: str, ordinal: str, systems: tuple[str, ...]) -> DataFrame:
    """One row per canonical id with each named system's last id, and the others' distinct ids in order."""
    named = [F.max_by(F.when(F.col(system) == s, F.col(source_id)), F.when(F.col(system) == s, F.col(ordinal))).alias(f"{s}_id") for s in systems]
    others = F.concat_ws(",", F.sort_array(F.collect_set(F.when(~F.col(system).isin(*systems), F.concat(F.col(system), F.lit(":"), F.col(source_id))))))
    return records.groupBy(canonical).agg(*named, others.alias("other_ids"))


def canonical_of(ids: DataFrame, id_col: str, index: DataFrame, canonical: str, system: str) -> DataFrame:
    """ids with the canonical id that the index has for an id of a system; null where it has none. Of several the last in order counts."""
    known = index.where(F.col(f"{system}_id").isNotNull()).groupBy(F.col(f"{system}_id").alias("_id")).agg(F.max(canonical).alias("canonical_id"))
    return ids.join(known, F.col(id_col).cast("string") == F.col("_id"), "left").drop("_id")


def counterpart(ids: DataFrame, id_col: str, index: DataFrame, canonical: str, system: str, other: str) -> DataFrame:
    """ids with the same person's id in another system, by the index; null where it has none."""
    known = index.where(F.col(f"{system}_id").isNotNull()).groupBy(F.col(f"{system}_id").alias("_id")).agg(F.max_by(f"{other}_id", canonical).alias("counterpart"))
    return ids.join(known, F.col(id_col).cast("string") == F.col("_id"), "left").drop("_id")


def unindexed(records: DataFrame, index: DataFrame, system: str, source_id: str, systems: tuple[str, ...]) -> DataFrame:
    """Records of the named systems whose id the index doesn't have, as a later record took its place."""
    known = [index.select(F.lit(s).alias("_s"), F.col(f"{s}_id").alias("_i")).where("_i is not null") for s in systems]
    both = known[0]
    for k in known[1:]:
        both = both.unionByName(k)
    return records.where(F.col(system).isin(*systems)).join(both.distinct(), (F.col(system) == F.col("_s")) & (F.col(source_id).cast("string") == F.col("_i")), "left_anti")


def key_mismatches(keys: Column, expected: Column) -> Column:
    """The names of expected keys that a map doesn't hold with the expected value, in order."""
    have = F.coalesce(keys, F.create_map().cast("map<string,string>"))
    return F.array_sort(F.map_keys(F.map_filter(expected, lambda k, v: ~F.coalesce(F.try_element_at(have, k).eqNullSafe(v), F.lit(False)))))


def find_alt_id(ids: Column, system: str, kind: str) -> Column:
    """The first current value among alternate ids (system, type, value, current), else the first; null where there is none."""
    own = F.filter(ids, lambda x: (x["system"] == system) & (x["type"] == kind))
    return F.coalesce(F.get(F.filter(own, lambda x: F.coalesce(x["current"], F.lit(False))), F.lit(0))["value"], F.get(own, F.lit(0))["value"])


def has_alt_id(ids: Column, system: str, kind: str, value: Column) -> Column:
    """Whether alternate ids hold a value, without regard to case."""
    return F.coalesce(F.exists(ids, lambda x: (x["system"] == system) & (x["type"] == kind) & (F.lower(x["value"]) == F.lower(value))), F.lit(False))


def current_status(kind: str, signals: dict[str, Column], at: Column) -> Column:
    """Whether a row is current by its pattern: activity (dated not after at), term (effective not after at), period (start <= at < end), indicator (blank), status (among the active), snapshot (always)."""
    on_or_before = lambda c: F.coalesce(c <= at, F.lit(False))
    if kind in ("activity", "term"):
        return on_or_before(signals["date"])
    if kind == "period":
        return on_or_before(signals["start"]) & (signals["end"].isNull() | (at < signals["end"]))
    if kind == "indicator":
        return F.coalesce(F.trim(signals["indicator"]), F.lit("")) == ""
    if kind == "status":
        return F.coalesce(signals["status"].isin(*signals["active"]), F.lit(False))
    if kind == "snapshot":
        return F.lit(True)
    raise ValueError(f"unknown pattern: {kind}")
