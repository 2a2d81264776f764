"""Filling containers of fixed capacity with items, in bulk-synchronous rounds of best fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.session import cut, tasks

CAPACITY = 2048
#: Items and gaps of a task, which holds them as arrays: at most, and from how many on there is more than one task for them.
ROWS_A_TASK, WORTH_A_TASK = 200_000, 8_000
#: The largest item left is small where so many of it fit into a container.
FINE = 8
#: Rows of a round's state: items without a container, gaps of containers, items placed in the round.
ITEM, GAP, PLACED = range(3)


def brackets(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of items and of the gaps that take them, each gap the nearest item before it that none has taken, as closing brackets take opening ones.

    At one depth opening and closing brackets follow each other in turn, so those of one depth, in
    order, are matched with their neighbours.
    """
    height = np.cumsum(np.where(is_gap, -1, 1))
    depth = np.where(is_gap, height + 1, height)
    order = np.argsort(depth, kind="stable")
    one, two = order[:-1], order[1:]
    met = (depth[one] == depth[two]) & ~is_gap[one] & is_gap[two]
    return one[met], two[met]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of items and gaps in ascending size, an item before a gap of its size.

    Each gap takes the largest item below it that none has taken. Rows come out with the container an
    item went to (match; -2 for a gap that took one, with what is left of it), or with their rank
    among those left; what is left are gaps (no item below them here) and then items.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables).combine_chunks()
    key, size, is_gap = t["key"].to_numpy(), t["size"].to_numpy(), t["kind"].to_numpy() == GAP
    items, gaps = brackets(is_gap)
    match, rank, left = np.full(len(key), -1), np.full(len(key), -1), np.zeros(len(key), "i8")
    match[items], match[gaps] = key[gaps], -2
    left[gaps] = size[gaps] - size[items]
    for side in (is_gap, ~is_gap):
        rest = np.flatnonzero(side & (match == -1))
        rank[rest] = np.arange(len(rest))
    yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks() for c in ("kind", "key", "size")), pa.array(match), pa.array(rank), pa.array(left)], names=["kind", "key", "size", "match", "rank", "left"])


def _router(segments: list[tuple[int, int, int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What becomes of a swept partition's rows: placed items, items and gaps that are left, and, where a segment matches them with rows of another partition, the two sides of a pair."""
    of: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}  # by kind and partition: first rank, step, number, segment
    for n, (items, i, gaps, g, size) in enumerate(segments):
        of.setdefault((ITEM, items), []).append((i, -1, size, n))
        of.setdefault((GAP, gaps), []).append((g, 1, size, n))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, key, size, match, rank, left, pid = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            out, seg, turn = np.where(match >= 0, PLACED, kind), np.full(len(kind), -1), np.full(len(kind), -1)
            for k in (ITEM, GAP):
                for first, step, n, number in of.get((k, int(pid[0])), ()) if len(pid) else ():
                    at = (rank - first) * step
                    met = (kind == k) & (rank >= 0) & (at >= 0) & (at < n)
                    seg[met], turn[met] = number, at[met]
            container = np.where(match >= 0, match, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (out.astype("i4"), key, np.where(match == -2, left, size), container, seg, turn)], names=["kind", "key", "size", "container", "seg", "turn"])

    return route


def _segments(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Brackets left by the partitions, matched over them: (items' partition, first rank, gaps' partition, first rank, number).

    parts: partition, gaps left, items left, in order of size. There are at most two segments for
    each partition. A partition's last items left are the largest and go first.
    """
    open_items: list[list[int]] = []
    out = []
    for pid, gaps, items in parts:
        at = 0
        while at < gaps and open_items:
            last = open_items[-1]
            n = min(gaps - at, last[1])
            # the gaps in ascending order take the items in descending order
            out.append((last[0], last[1] - 1, pid, at, n))
            at, last[1] = at + n, last[1] - n
            if not last[1]:
                open_items.pop()
        if items:
            open_items.append([pid, items])
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, piece, start, size, container_id): every item in a container, no container above the capacity.

    An item above the capacity is split: pieces of full capacity, each a container of its own, and
    the rest, placed like an item. No other item is split.

    Containers are opened for the sum of all sizes. Once the largest item left is small, a gap
    counts as several of equal size, as many as that item fits into it, so that no round is lost on
    small items.
    Items and gaps are range-sorted by size together; sweeps match every gap with the largest item
    that fits and that no smaller gap took: within the partitions first, then, over what these leave,
    between them, for which the driver gets two counts per partition. Gaps shrink by what they took,
    and the round repeats. When no gap takes an item, containers for the items that are left are
    opened. Each round's state is written to the checkpoint folder.

    Defined cases: a null or negative size counts as 0; items of size 0 go to container 0 and take no
    room; an id may be null or repeat, each row is an item; an empty table gives no rows; further
    columns are ignored.
    """
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(id_col).alias("id"), size.alias("size"), F.monotonically_increasing_id().alias("key"))
    rows = cut(rows)
    full = F.floor(F.col("size") / capacity)
    whole = rows.where(F.col("size") >= capacity).select("id", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece"), F.lit(capacity).cast("long").alias("size"), F.col("key"))
    rest = rows.select("id", full.cast("int").alias("piece"), (F.col("size") - full * capacity).alias("size"), "key")
    rest = rest.where((F.col("size") > 0) | (F.col("piece") == 0))
    # a document fills its own containers from the key's place on, above all that are opened below
    whole = whole.select("id", "piece", "size", F.concat(F.lit("w"), F.col("key"), F.lit("."), F.col("piece")).alias("container"))
    nothing = rest.where(F.col("size") == 0).select("id", "piece", "size", F.lit("g0").alias("container"))

    spark = items.sparkSession
    state = rest.where(F.col("size") > 0).select(F.lit(ITEM).alias("kind"), "key", "size")
    placed: list[DataFrame] = []
    opened = moved = 0
    while True:
        is_item = F.col("kind") == ITEM
        now = state.agg(F.count_if(is_item).alias("n"), F.count_if(~is_item).alias("gaps"), *[f(F.when(is_item, F.col("size"))).alias(c) for c, f in (("total", F.sum), ("low", F.min), ("high", F.max))]).first()
        if not now["n"]:
            break
        if not moved:
            new = max(1, -(-now["total"] // capacity))
            state = state.unionByName(spark.range(opened, opened + new).select(F.lit(GAP).alias("kind"), F.col("id").alias("key"), F.lit(capacity).cast("long").alias("size")))
            opened += new
        # gaps below the smallest item can take nothing any more; of small items the others count as often as the largest fits, the first with what is over
        parts = F.greatest(F.lit(1).cast("long"), F.floor(F.col("size") / now["high"])) if now["high"] * FINE <= capacity else F.lit(1).cast("long")
        gaps = state.where((F.col("kind") == GAP) & (F.col("size") >= now["low"])).select("kind", "key", "size", parts.alias("_n")).select("kind", "key", "size", "_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_at"))
        gaps = gaps.select("kind", "key", (F.floor(F.col("size") / F.col("_n")) + F.when(F.col("_at") == 1, F.col("size") % F.col("_n")).otherwise(0)).cast("long").alias("size"))
        n = min(-(-2 * now["n"] // WORTH_A_TASK), tasks(spark, 2 * now["n"], ROWS_A_TASK))
        both = state.where(is_item).unionByName(gaps).repartitionByRange(n, "size", "kind", "key").sortWithinPartitions("size", "kind", "key")
        swept = cut(both.mapInArrow(_sweep, "kind int, key bigint, size bigint, match bigint, rank bigint, left bigint").withColumn("pid", F.spark_partition_id()))
        counts = swept.groupBy("pid").agg(F.count_if(~is_item & (F.col("rank") >= 0)).alias("gaps"), F.count_if(is_item & (F.col("rank") >= 0)).alias("items"), F.count_if(F.col("match") >= 0).alias("n")).collect()
        segments = _segments(sorted((r["pid"], r["gaps"], r["items"]) for r in counts))
        moved = sum(r["n"] for r in counts) + sum(s[4] for s in segments)
        routed = swept.mapInArrow(_router(segments), "kind int, key bigint, size bigint, container bigint, seg bigint, turn bigint")
        own = routed.where("seg < 0").select("kind", "key", "size", "container")
        # only rows that have a partner in another partition are shuffled to it
        item, gap = F.when(is_item, F.struct("key", "size")), F.when(~is_item, F.struct("key", "size"))
        met = routed.where("seg >= 0").groupBy("seg", "turn").agg(F.max(item).alias("i"), F.max(gap).alias("g"))
        two = F.array(F.struct(F.lit(PLACED).alias("kind"), F.col("i.key").alias("key"), F.col("i.size").alias("size"), F.col("g.key").alias("container")), F.struct(F.lit(GAP).alias("kind"), F.col("g.key").alias("key"), (F.col("g.size") - F.col("i.size")).alias("size"), F.lit(-1).cast("long").alias("container")))
        met = met.select(F.explode(two).alias("x")).select("x.*")
        # the parts of a gap are one again
        every = own.unionByName(met).groupBy("kind", "key").agg(F.sum("size").alias("size"), F.max("container").alias("container")).where("size > 0")
        after = cut(every.coalesce(n))
        placed.append(after.where(F.col("kind") == PLACED).select("key", "container"))
        state = after.where(F.col("kind") != PLACED).select("kind", "key", "size")
    out = whole.unionByName(nothing)
    if placed:
        where = reduce(DataFrame.unionByName, placed)
        out = out.unionByName(rest.where("size > 0").join(where.withColumnRenamed("container", "c"), "key").select("id", "piece", "size", F.concat(F.lit("g"), F.col("c")).alias("container")))
    return out.select(F.col("id").alias(id_col), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "size", F.col("container").alias("container_id"))
