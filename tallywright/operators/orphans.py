"""References to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.session import BROADCAST_ROWS, cut, small

#: Child rows of one reference and period from which these are looked up where they lie, not gathered by key.
HOT = 100_000
#: Rows of a key range for which bitmaps are built at once.
RANGE_ROWS = 1 << 16
#: Periods that stand for "before all" (a parent without load time) and "after all" (a child without one).
FIRST, LAST = -1, 1 << 30
KINDS = ("missing", "deleted", "late")
#: Stands for no kind: a reference that has a good parent and many rows.
GOOD = -1


@dataclass(frozen=True)
class Reference:
    """Rows of `child` whose child_key refers to parent_key of `parent`. Keys are texts in one notation, null where there is none. live: whether a parent's row is."""

    child_table: str
    child: DataFrame
    child_key: Column
    parent: DataFrame
    parent_key: Column
    live: Column
    row_id: str = "row_id"
    loaded_at: str = "loaded_at"


def _bitmap(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A compressed bitmap of n bits: places and contents of the 64-bit words that aren't zero."""
    bits = np.zeros(-(-n // 64) * 64, bool)
    bits[codes] = True
    words = np.packbits(bits, bitorder="little").view("<u8")
    at = np.flatnonzero(words)
    return at, words[at]


def _and_not(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The codes that are in one bitmap and not in the other, decoded."""
    at, words = one
    place = np.searchsorted(other[0], at)
    inside = np.append(other[0], -1)[place] == at
    left = words & ~np.where(inside, np.append(other[1], np.uint64(0))[place], np.uint64(0))
    bits = np.unpackbits(left.view("u1").reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return at[word] * 64 + bit


def _range(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The references of one key range that no good parent answers, and those with one that have more than HOT rows."""
    coded = t["key"].combine_chunks().dictionary_encode()  # sorted by key: the codes are dense and in order
    codes, names, n = coded.indices.to_numpy(), coded.dictionary, len(coded.dictionary)
    period, parent = t["period"].to_numpy(), t["parent"].to_numpy().astype(bool)
    first = np.full(n, LAST + 1)
    known, live, earliest = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, "i8")
    own = codes[parent]
    known[own], first[own] = True, period[parent]
    live[own], earliest[own] = t["live"].to_numpy().astype(bool)[parent], t["earliest"].to_numpy()[parent]
    for k in np.unique(period[~parent]):
        own = ~parent & (period == k)
        rows = np.zeros(n, "i8")
        rows[codes[own]] = t["n"].to_numpy()[own]
        children = _bitmap(codes[own], n)
        good = _bitmap(np.flatnonzero(live & (first < k)), n)
        left = _and_not(children, good)
        hot = np.setdiff1d(np.flatnonzero(rows > HOT), left)
        at = np.concatenate([left, hot])
        if len(at):
            kind = np.where(~known[left], 0, np.where(~live[left], 1, 2))
            kinds = np.concatenate([kind, np.full(len(hot), GOOD)]).astype("i4")
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(np.full(len(at), k, "i4")), pa.array(kinds), pa.array(earliest[at]), pa.array(rows[at])], names=["key", "period", "kind", "earliest", "n"])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition, sorted by ref and key, in key ranges of some RANGE_ROWS rows; a key is never split."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(all_rows: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, rows
        t = pa.Table.from_batches(held).combine_chunks()
        ref, key = t["ref"].to_numpy(), t["key"].combine_chunks()
        changed = np.append(True, (ref[1:] != ref[:-1]) | pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))
        last = len(ref) if all_rows else int(np.flatnonzero(changed)[-1])
        for r in np.unique(ref[:last]):
            a, b = np.searchsorted(ref[:last], r), np.searchsorted(ref[:last], r, side="right")
            for x in _range(t.slice(int(a), int(b - a))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.num_rows, r, "i4")), *x.columns], names=["ref", *x.schema.names])
        held, rows = t.slice(last).to_batches(), len(ref) - last

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RANGE_ROWS:
                yield from flush(False)
    if rows:
        yield from flush(True)


def _month(c: Column, otherwise: int) -> Column:
    return F.coalesce(F.year(c) * 12 + F.month(c) - 1, F.lit(otherwise)).cast("int")


def orphans(references: list[Reference]) -> DataFrame:
    """Rows (child_table, row_id, period, kind) of children whose reference has no good parent.

    kind: missing if no parent has the key; deleted if none that has it is live; late if a live one
    exists, but the earliest load of the key's parents is after the child's load. period is the
    month of the child's load, YYYY-MM, null where that is unknown.

    Parents are reduced to one row per key and children to one per key and month on the map side.
    Both are range-partitioned and sorted by key together. Each key range gets a dictionary of dense
    integers and compressed bitmaps over it, of children per month and of live parents loaded in
    earlier months; children AND NOT parents gives the references in question, which are decoded to
    keys, joined to the children's rows, and, where parent and child came in one month or the parent
    later, settled by their times. Up to BROADCAST_ROWS references in question, counted, the rows are
    looked up where they lie; beyond that only those of references with more than HOT rows are, which
    are few, and the others meet by key.

    Defined cases: a null key is no reference; a parent's null key is no parent; a null load time of
    a child is never late, of a parent before all others; repeated rows are reported each; an empty
    table of parents makes every reference missing.
    """
    parts = []
    for n, r in enumerate(references):
        micros = F.unix_micros(F.col("_at").cast("timestamp"))
        parents = r.parent.select(r.parent_key.alias("key"), F.col(r.loaded_at).alias("_at"), r.live.cast("int").alias("live")).where(F.col("key").isNotNull())
        parents = parents.groupBy("key").agg(F.min("_at").alias("_at"), F.max("live").alias("live"))
        parts.append(parents.select(F.lit(n).alias("ref"), "key", _month(F.col("_at"), FIRST).alias("period"), F.lit(1).alias("parent"), F.coalesce("live", F.lit(0)).alias("live"), F.coalesce(micros, F.lit(-(1 << 62))).alias("earliest"), F.lit(0).cast("bigint").alias("n")))
        children = r.child.select(r.child_key.alias("key"), _month(F.col(r.loaded_at), LAST).alias("period")).where(F.col("key").isNotNull()).groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"))
        parts.append(children.select(F.lit(n).alias("ref"), "key", "period", F.lit(0).alias("parent"), F.lit(0).alias("live"), F.lit(0).cast("bigint").alias("earliest"), "n"))
    together = reduce(DataFrame.unionByName, parts).repartitionByRange("ref", "key").sortWithinPartitions("ref", "key")
    found = cut(together.mapInArrow(_survivors, "ref int, key string, period int, kind int, earliest bigint, n bigint"))
    rows = []
    for n, r in enumerate(references):
        rows.append(r.child.select(F.lit(n).alias("ref"), F.lit(r.child_table).alias("child_table"), r.child_key.alias("key"), _month(F.col(r.loaded_at), LAST).alias("period"), F.col(r.row_id).alias("row_id"), F.unix_micros(F.col(r.loaded_at).cast("timestamp")).alias("_at")).where(F.col("key").isNotNull()))
    rows = reduce(DataFrame.unionByName, rows)
    on, orphaned = ["ref", "key", "period"], found.where(F.col("kind") > GOOD).drop("n")
    if orphaned.count() <= BROADCAST_ROWS:
        met = rows.join(F.broadcast(orphaned), on)
    else:
        hot = F.col("n") > HOT
        met = rows.join(small(found.where(hot).select(*on)), on, "left_anti").join(found.where(~hot).drop("n"), on)
        met = met.unionByName(rows.join(small(found.where(hot & (F.col("kind") > GOOD)).drop("n")), on).select(*met.columns))
    met = met.where((F.col("kind") < 2) | (F.col("earliest") > F.col("_at")))
    month = F.when(F.col("period") < LAST, F.format_string("%04d-%02d", (F.col("period") / 12).cast("int"), F.col("period") % 12 + 1))
    return met.select("child_table", "row_id", month.alias("period"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("kind"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """One row per child table, month and kind with the number of rows."""
    return found.groupBy("child_table", "period", "kind").agg(F.count(F.lit(1)).alias("n"))
