"""Column-level data quality profile of loads, with changes between a load and the one before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import values as V
from tallywright.session import cut, small


def _sorted_runs(group: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)


def prefix_sums(df: DataFrame, group: str, order: list[str], weights: list[str]) -> DataFrame:
    """df with <weight>_upto, the sum of each weight over the group's rows up to and with this one.

    The rows are range-sorted by group and order over all partitions, so a group of any size may
    span many of them. Each partition's sums per group give the partitions after it their offsets;
    the sums inside a partition are a running total. Nothing but one row per partition and group
    that reaches into it is gathered. group must be a bigint that identifies the group; ties in order
    are settled arbitrarily, so order should be a key within its group.
    """
    placed = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_pid", F.spark_partition_id()))
    totals = placed.groupBy("_pid", group).agg(*[F.sum(w).alias(w) for w in weights])
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_pid").alias("_opid"), F.col(group).alias("_ogroup"), *[F.coalesce(F.sum(w).over(before), F.lit(0)).cast("double").alias(f"_off_{w}") for w in weights])
    # only groups that began in an earlier partition have an offset: at most one per partition
    offsets = offsets.where(F.greatest(*[F.abs(F.col(f"_off_{w}")) for w in weights], F.lit(0.0)) > 0)
    fields = [f for f in placed.schema.fields if f.name != "_pid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(len(weights))
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(b.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            starts = _sorted_runs(g)
            sizes = np.diff(np.append(starts, len(g)))
            sums = []
            for n, w in enumerate(weights):
                x = b.column(b.schema.get_field_index(w)).to_numpy(zero_copy_only=False).astype(float)
                total = np.cumsum(x)
                base = np.repeat(np.append(0.0, total[starts[1:] - 1]), sizes)
                upto = total - base
                if g[0] == last:
                    upto[: sizes[0]] += carried[n]
                sums.append(upto)
            last, carried = g[-1], np.array([s[-1] for s in sums])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums)], names=[*b.schema.names, *[f"{w}_upto" for w in weights]])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields] + [f"`{w}_upto` double" for w in weights])
    summed = placed.mapInArrow(run, schema)
    summed = summed.join(small(offsets), (F.col("_pid") == F.col("_opid")) & (F.col(group) == F.col("_ogroup")), "left")
    return summed.select(*[f.name for f in fields], *[(F.col(f"{w}_upto") + F.coalesce(F.col(f"_off_{w}"), F.lit(0.0))).alias(f"{w}_upto") for w in weights])


#: Words, marks and dates that stand for an unknown value.
FILLER_WORDS = ("", "-", "--", ".", "?", "n/a", "na", "n/k", "nk", "none", "nil", "null", "nan", "unknown", "not known", "tbc", "tbd", "x", "xx", "xxx")
FILLER_DATES = ("0000-00-00", "0001-01-01", "1111-11-11", "1900-01-01", "9999-12-31", "9999-99-99")
FILLER_CODES = ("000", "999")


def is_missing(c: Column, fillers: tuple[str, ...] = ()) -> Column:
    """Null, blank, or a filler that stands for an unknown value."""
    s = V.folded(c)
    return c.isNull() | s.isin(*FILLER_WORDS, *fillers)


def column_values(df: DataFrame, name: str, tenant: str, load: str, date: str, value: Column, missing: Column, well: Column, measure: Column, out: Column) -> DataFrame:
    """One column of one table in the long form that profile() takes.

    missing, well (well-formed) and out (out of range) say what a value is; measure is its place on
    the axis of its distribution.
    """
    well = ~missing & F.coalesce(well, F.lit(False))
    return df.select(
        F.lit(name).alias("column_name"), F.col(tenant).alias("tenant"), F.col(load).alias("load_id"), F.col(date).cast("date").alias("load_date"), value.cast("string").alias("value"),
        missing.alias("missing"), well.alias("well"), F.when(well, measure).cast("double").alias("measure"), F.coalesce(out, F.lit(False)).alias("out"),
    )


GROUP = ["column_name", "load_id"]


def profile(values: DataFrame) -> DataFrame:
    """One row per column and load: rates, distinct counts, ranges, exact medians, and changes against the tenant's load before.

    rows, missing, ill_formed, well_formed, out_of_range (counts), distinct, low, high, median, mean
    of the well-formed values' measures, heap (the largest share one well-formed value has), and
    against the tenant's previous load by date (then id): previous_load, median_before, mean_before,
    ks (the exact Kolmogorov-Smirnov distance of the measures), tv (half the sum of absolute
    differences between shares of values).

    Values are unpivoted by the caller and counted on the map side, so a value that fills a third of
    a load is one row. The counts are range-sorted by column, load and value; prefix counts over the
    partitions give medians and distinct counts. For each load and the one before, both counts are
    sorted together, and the prefix counts are the two cumulative curves.

    Defined cases: a load without well-formed values has null statistics and no change; NaN is never
    well-formed; rows that came twice count twice; the first load of a tenant has no change; an
    empty table gives no rows.
    """
    cells = cut(values.groupBy(*GROUP, "tenant", "load_date", "value", "missing", "well", "measure", "out").agg(F.count(F.lit(1)).alias("n")))
    n = F.col("n")
    well, out = F.col("well"), F.col("out")
    of = cells.groupBy(*GROUP).agg(
        F.min("tenant").alias("tenant"), F.min("load_date").alias("load_date"), F.sum(n).alias("rows"), F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("missing"),
        F.sum(F.when(~F.col("missing") & ~well, n).otherwise(0)).alias("ill_formed"), F.sum(F.when(well, n).otherwise(0)).alias("well_formed"), F.sum(F.when(out, n).otherwise(0)).alias("out_of_range"),
        F.min("measure").alias("low"), F.max("measure").alias("high"), F.try_divide(F.sum(F.col("measure") * n), F.sum(F.when(well, n))).alias("mean"), F.max(F.when(well, n)).alias("_most"),
    )
    by_date = Window.partitionBy("column_name", "tenant").orderBy("load_date", "load_id")
    of = cut(of.withColumns({"previous_load": F.lag("load_id").over(by_date), "mean_before": F.lag("mean").over(by_date), "_well_before": F.lag("well_formed").over(by_date), "_next": F.lead("load_id").over(by_date), "_next_well": F.lead("well_formed").over(by_date)}))

    good = cells.where("well").select(*GROUP, "value", "measure", "n", F.concat_ws("|", "column_name", F.col("load_id").cast("string")).alias("_group"))
    ranked = prefix_sums(good, "_group", ["measure", "value"], ["n"]).join(small(of.select(*GROUP, "well_formed")), GROUP)
    low_rank, high_rank = F.floor((F.col("well_formed") + 1) / 2), F.floor((F.col("well_formed") + 2) / 2)
    holds = lambda rank: (F.col("n_upto") >= rank) & (F.col("n_upto") - n < rank)
    medians = ranked.groupBy(*GROUP).agg(((F.max(F.when(holds(low_rank), F.col("measure"))) + F.max(F.when(holds(high_rank), F.col("measure")))) / 2).alias("median"), F.count(F.lit(1)).alias("distinct"))

    # each count serves its own load's comparison and, as "before", that of the load after
    roles = good.join(small(of.select(*GROUP, "well_formed", "previous_load", "_next", "_next_well", "_well_before")), GROUP)
    now = F.when(F.col("previous_load").isNotNull() & (F.col("_well_before") > 0), F.struct(F.col("load_id").alias("at"), (n / F.col("well_formed")).alias("now"), F.lit(0.0).alias("before")))
    then = F.when(F.col("_next").isNotNull() & (F.col("_next_well") > 0), F.struct(F.col("_next").alias("at"), F.lit(0.0).alias("now"), (n / F.col("well_formed")).alias("before")))
    shares = roles.select("column_name", "value", "measure", F.explode(F.filter(F.array(now, then), lambda x: x.isNotNull())).alias("_s"))
    shares = shares.groupBy("column_name", F.col("_s.at").alias("load_id"), "measure", "value").agg(F.sum("_s.now").alias("now"), F.sum("_s.before").alias("before"))
    curves = prefix_sums(shares.withColumn("_group", F.concat_ws("|", "column_name", F.col("load_id").cast("string"))), "_group", ["measure", "value"], ["now", "before"])
    # values of one measure are one step of the curve: its height is known at the last of them
    steps = curves.groupBy(*GROUP, "measure").agg(F.max("now_upto").alias("a"), F.max("before_upto").alias("b"), F.sum(F.abs(F.col("now") - F.col("before"))).alias("d"))
    changes = steps.groupBy(*GROUP).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("ks"), (F.sum("d") / 2).alias("tv"))

    out_rows = of.join(medians, GROUP, "left").join(changes, GROUP, "left")
    out_rows = out_rows.withColumn("median_before", F.lag("median").over(by_date))
    return out_rows.select(
        "column_name", "tenant", "load_id", "load_date", "rows", "missing", "ill_formed", "well_formed", "out_of_range", F.coalesce("distinct", F.lit(0)).alias("distinct"), "low", "high", "median", "mean",
        F.try_divide("_most", "well_formed").alias("heap"), "previous_load", "median_before", "mean_before", "ks", "tv",
    )
