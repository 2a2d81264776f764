"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.merge import key_window, newest, range_sorted
from tallywright.session import small


def map_text(c: Column) -> Column:
    """A map as text, whatever the order of its entries. A null map, an empty one, an absent and a null value all differ."""
    return F.coalesce(F.to_json(F.array_sort(F.map_entries(c))), F.lit("null"))


def joined_map(c: Column) -> Column:
    """k=v sorted by k and joined by |; empty for a null or empty map; a null value is an empty one."""
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.concat_ws("|", pairs), F.lit(""))


def fingerprint(*parts: Column) -> Column:
    """128 bits of the parts in their order; null parts differ from empty ones."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("v"), p), F.lit("n")) for p in parts]))))


def snapshot_delta(
    df: DataFrame,
    group: str,
    run: str,
    started: str,
    delivery: str,
    key: Column,
    state: Column,
    version: tuple[str, ...] = ("detected_at", "row_id"),
) -> DataFrame:
    """Rows (group, run, delta_key, kind): what a run's snapshot has new, resolved or changed against the group's one before.

    df has one row per item and snapshot. Of a run only the last delivery counts, of rows with one
    key in it the one with the greatest version. Runs of a group follow each other by `started`, then
    by run; a run that delivered nothing is no snapshot. state: what must be equal for an item to be
    unchanged.

    Rows of one run and key are reduced on the map side; the rest is range-partitioned by group and
    key, sorted by key and run, and merged in one pass: a row whose neighbour is not from the run
    before is new, one without a neighbour in the run after is resolved there.

    Defined cases: a null delivery is before all others; a null key, run or group is a value like
    others; an empty table gives no rows; further columns are ignored.
    """
    own = df.select(F.col(group).alias("_g"), F.col(run).alias("_run"), F.col(started).alias("_at"), F.coalesce(F.col(delivery).cast("long"), F.lit(-1)).alias("_d"), key.alias("_key"), state.alias("_state"), *[F.col(v).alias(f"_v{n}") for n, v in enumerate(version)])
    runs = own.groupBy("_g", "_run").agg(F.max("_at").alias("_at"), F.max("_d").alias("_last"))
    by_time = Window.partitionBy("_g").orderBy("_at", "_run")
    runs = runs.select("_g", "_run", "_last", F.row_number().over(by_time).alias("_seq"), F.lead("_run").over(by_time).alias("_run_after"), F.lead(F.lit(True)).over(by_time).alias("_more"))
    runs = small(runs.withColumnsRenamed({"_g": "_rg", "_run": "_rr"}))
    own = own.join(runs, F.col("_g").eqNullSafe(F.col("_rg")) & F.col("_run").eqNullSafe(F.col("_rr")) & (F.col("_d") == F.col("_last")))
    once = newest(own, ["_g", "_seq", "_key"], [f"_v{n}" for n in range(len(version))], ["_run", "_run_after", "_more", "_state"])
    window = key_window(["_g", "_key"], ["_seq"])
    near = range_sorted(once, ["_g", "_key"], ["_seq"]).withColumns({"_seq_before": F.lag("_seq").over(window), "_state_before": F.lag("_state").over(window), "_seq_after": F.lead("_seq").over(window)})
    follows = F.coalesce(F.col("_seq_before") == F.col("_seq") - 1, F.lit(False))
    stays = F.coalesce(F.col("_seq_after") == F.col("_seq") + 1, F.lit(False))
    here = F.when(~follows & (F.col("_seq") > 1), F.struct(F.col("_run").alias("run"), F.lit("new").alias("kind"))).when(follows & ~F.col("_state").eqNullSafe(F.col("_state_before")), F.struct(F.col("_run").alias("run"), F.lit("changed").alias("kind")))
    after = F.when(~stays & F.col("_more"), F.struct(F.col("_run_after").alias("run"), F.lit("resolved").alias("kind")))
    cases = F.filter(F.array(here, after), lambda x: x.isNotNull())
    return near.select(F.col("_g").alias(group), "_key", F.explode(cases).alias("_case")).select(group, F.col("_case.run").alias(run), F.col("_key").alias("delta_key"), F.col("_case.kind").alias("kind"))


def delta_counts(delta: DataFrame, run: str) -> DataFrame:
    """One row per run with the numbers of new, resolved and changed items."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return delta.groupBy(run).agg(n("new").alias("new_count"), n("resolved").alias("resolved_count"), n("changed").alias("changed_count"))
