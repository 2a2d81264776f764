"""The streaming merge that comparisons share: one range partitioning for all copies, sorted by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], version: list[Column | str], keep: list[str]) -> DataFrame:
    """One row per key, the one with the greatest version; nulls in version come first.

    It aggregates on the map side, so a key that holds many rows sends one row per task.
    Keys may be null; null keys make one group.
    """
    order = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in version])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), order).alias("_kept")).select(*keys, *[F.col(f"_kept.`{c}`").alias(c) for c in keep])


def range_sorted(df: DataFrame, keys: list[str], then: list[str]) -> DataFrame:
    """All copies under shared split points, each partition sorted by key and then by the given columns.

    A window over the keys runs on this without another exchange or sort: it is the merge, one pass
    over neighbouring rows. The keys' groups must be small; see newest().
    """
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys, *then)


def key_window(keys: list[str], then: list[str]):
    return Window.partitionBy(*keys).orderBy(*then)
