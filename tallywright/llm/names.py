"""Linking variant spellings of people's names: MinHash banding, Monge-Elkan, star clustering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.persons import KINDS, PAIR, PAIR_NAMES, TWO_PARTS, Batch, Evidence, evidence, number, numbers, settle, tally, weigh
from tallywright.session import cut, small, tasks

#: Records of a range of blocks that are compared at once, and records for a task.
RANGE_ROWS, ROWS_A_TASK = 1 << 16, 60_000
#: Records with one birth date, and with one address, from which its block is divided by the names: what is compared at once in memory.
#: Addresses have more bands with fewer rows, so more pairs. Divided or not, the same pairs are compared.
HOT, HOT_ADDRESS = 20_000, 2_000
#: Bits above log2 of the number of records that make two records one person's without doubt, and likeness their names must have.
MARGIN, MIN_LIKE, MIN_SHARE = 5.0, 0.72, 0.4
#: Bits that are enough in any table where they are more likely one person's than chance, and the least margin that is looked at: likely().
ENOUGH, LEAST_MARGIN = 24.5, -2.0


def bands(similarity: float, recall: float, rows: int) -> int:
    """How many bands of so many rows find a pair of that similarity with that probability: 1 - (1 - s^r)^b >= recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


#: What a block is of: a birth date, an e-mail address, a postcode; of a hot one of these the records that collide in one band; a band alone.
BORN, EMAIL, POST, PART, NAME = range(5)
#: Rows and bands of each; the bands of NAME are blocks themselves.
ROWS = (2, 1, 1, 0, 0)
BANDS = (bands(0.42, 0.95, 2), bands(0.25, 0.95, 1), bands(0.25, 0.95, 1), 1, 1)
NAME_ROWS, NAME_BANDS = 6, bands(0.95, 0.95, 6)


def _keys(block: np.ndarray, signature: np.ndarray, rows: int, n: int) -> Iterator[np.ndarray]:
    """The records' keys in each band: equal where block and the band's MinHash values are."""
    for b in range(n):
        key = block.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = (key ^ signature[:, b * rows + r].astype("u8")) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
        yield key


def _collisions(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal keys."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    left, right = [], []
    at = np.arange(len(key))
    step = 1
    while len(at := at[at + step < len(key)]):
        at = at[sorted_key[at] == sorted_key[at + step]]
        left.append(order[at])
        right.append(order[at + step])
        step += 1
    i, j = np.concatenate(left or [at]), np.concatenate(right or [at])
    return np.minimum(i, j), np.maximum(i, j)


def _links(t: pa.Table, known: Evidence, threshold: float) -> pa.RecordBatch | None:
    """The links among the records of whole blocks, with their bits as settle() takes them."""
    block, source, person = numbers(t, "block"), numbers(t, "packed") % 8, numbers(t, "person")
    starts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (source[1:] != source[:-1])))
    several = np.minimum.reduceat(person, starts) != np.maximum.reduceat(person, starts)
    t = t.filter(pa.array(np.repeat(several, np.diff(np.append(starts, len(block))))))
    if not t.num_rows:
        return None
    block, packed, person, email, post = (numbers(t, c) for c in ("block", "packed", "person", "email", "post"))
    source, kind, born = packed % 8, packed // 8 % 8, packed // 64
    # a block's own value is not repeated in its records
    batch = Batch(t["name"].combine_chunks(), born, np.where(kind == EMAIL, block, email), np.where(kind == POST, block, post), known)
    signature = batch.signature(max(r * b for r, b in zip(ROWS, BANDS, strict=True)))
    block = block ^ source  # records of one source only are compared
    found = []
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        for key in _keys(block[own], signature[own], ROWS[k], BANDS[k]):
            i, j = _collisions(key)
            i, j = own[i], own[j]
            ok = (source[i] == source[j]) & (person[i] != person[j])
            found.append(i[ok] * len(block) + j[ok])
    pairs = np.unique(np.concatenate(found))
    i, j = pairs // len(block), pairs % len(block)
    same_mail = (batch.email[i] == batch.email[j]) & (batch.email[i] != 0)
    ok = same_mail | (batch.share(i, j) >= MIN_SHARE)
    i, j = i[ok], j[ok]
    # names can't give more than all their parts, so most pairs need no comparison of them
    most = batch.most_bits()[batch.code]
    ok = batch.dates(i, j) + batch.contact("email", i, j, -1.5) + batch.contact("post", i, j, -1.0) + np.minimum(most[i], most[j]) >= threshold - 1e-6
    i, j = i[ok], j[ok]
    w = weigh(batch, i, j)
    same_mail = (batch.email[i] == batch.email[j]) & (batch.email[i] != 0)
    ok = np.flatnonzero((w.total >= threshold) & (same_mail | (w.like >= MIN_LIKE)))
    a, b = person[i[ok]], person[j[ok]]
    return pa.RecordBatch.from_arrays([pa.array(source[i[ok]].astype("i4")), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), *w.columns(ok)], names=["source", "a", "b", *PAIR_NAMES])


def whole_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A sorted partition in tables of at least so many rows (the last may be smaller) that split no block."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            block = t["block"].to_numpy()
            last = int(np.searchsorted(block, block[-1]))
            if last:
                yield t.slice(0, last).combine_chunks()
                held, n = t.slice(last).to_batches(), n - last
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def link(records: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Links (a, b, source, bits) between persons of one source whose records are the same person's.

    records as people() gives them, with person, a number for each source and key. Candidates are
    records whose names' padded 2-grams collide in a MinHash band; the number of bands follows from
    the collision curve. They are verified by Monge-Elkan likeness and by the bits of all evidence.

    How wide the bands are depends on what the names alone can say. A pair with no address in common
    and at most two parts of the birth date needs names that reach the threshold nearly alone, which
    all parts of a name equal to the other's hardly do unless they are rare: names with enough bits (for
    MARGIN at least, as names alone are never enough with less)
    have narrow bands over all records (NAME_ROWS, NAME_BANDS). In such a band there are few records,
    as names that many have don't have the bits. All other pairs share a birth date (day and month in
    either order), an e-mail address or a postcode: within these the bands are wide, and every
    record is in them, whatever its name.

    Blocks are compared where they lie, so only records are shuffled, not pairs. A birth date or
    address that more than HOT or HOT_ADDRESS records share is divided by the same bands first, a
    part for each value of each band, so the same pairs are compared as in the whole block (of a
    birth date, as far as day and month are not exchanged).
    """
    spark = records.sparkSession
    counts = tally(records)
    known = evidence(records, counts)
    threshold, alone = (float(np.log2(max(2, known.n)) + m) for m in (margin, max(margin, MARGIN)))
    shared = spark.sparkContext.broadcast((known.n, known.parts, known.born, known.email, known.post))
    fields = ["source", "person", "name", "born", "email", "post"]
    # as they are shuffled: birth date, kind of block and source in one number
    schema = "block bigint, person bigint, email bigint, post bigint, packed bigint, name string"

    def rows(key: np.ndarray, kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
        """Some records in blocks of one kind."""
        t = pa.Table.from_batches([b])
        packed = (numbers(t, "born").astype("i8") * 8 + kind) * 8 + numbers(t, "source")
        own = [t[c].combine_chunks() for c in ("person", "email", "post")]
        return pa.RecordBatch.from_arrays([pa.array(key.view("i8")), *own, pa.array(packed), t["name"].combine_chunks()], names=["block", "person", "email", "post", "packed", "name"])

    # which values are hot: as many rows as there are such values
    hot = [counts.where((F.col("kind") == n) & (F.col("c") > (HOT_ADDRESS if n else HOT))).select(F.col("value").alias(c)).withColumn(f"hot_{c}", F.lit(True)) for n, c in enumerate(KINDS)]
    flags = {c: F.lit(False) for c in KINDS}
    for n, c in enumerate(KINDS):
        if not hot[n].isEmpty():
            records = records.join(small(hot[n].withColumn(c, F.col(c).cast(dict(records.dtypes)[c]))), c, "left")
            flags[c] = F.col(f"hot_{c}").isNotNull()
    y, m, d = F.floor(F.col("born") / 10000), F.floor(F.col("born") / 100) % 100, F.col("born") % 100
    block = lambda c, kind, of: F.when(F.col(c).isNotNull() & ~flags[c], F.struct(of.cast("bigint").alias("block"), F.lit(kind).alias("kind")))
    blocks = F.array(block("born", BORN, y * 10000 + F.least(m, d) * 100 + F.greatest(m, d)), block("email", EMAIL, F.col("email")), block("post", POST, F.col("post")))
    placed = records.select(*fields, F.explode(F.filter(blocks, lambda x: x.isNotNull())).alias("_b"))
    own = {"email": F.when(F.col("_b.kind") != EMAIL, F.col("email")).alias("email"), "post": F.when(F.col("_b.kind") != POST, F.col("post")).alias("post")}
    packed = (F.coalesce("born", F.lit(0)).cast("bigint") * 8 + F.col("_b.kind")) * 8 + F.col("source")
    placed = placed.select("_b.block", "person", own["email"], own["post"], packed.alias("packed"), "name")

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = Evidence(1)
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                columns = {c: numbers(t, c) for c in KINDS}
                signature = Batch(t["name"].combine_chunks(), *columns.values(), none).signature(max(r * n for r, n in zip(ROWS, BANDS, strict=True)))
                for k, c in enumerate(KINDS):
                    at = np.flatnonzero(numbers(t, f"hot_{c}"))
                    for n, key in enumerate(_keys(columns[c][at], signature[at], ROWS[k], BANDS[k])) if len(at) else ():
                        key = (key ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)  # a part for each band
                        yield rows(key, PART, b.take(pa.array(at)))

    if len(records.columns) > len(fields):
        heated = records.where(flags["born"] | flags["email"] | flags["post"]).select(*fields, *[f.cast("int").alias(f"hot_{c}") for c, f in flags.items()])
        placed = placed.unionByName(heated.mapInArrow(divide, schema))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evid = Evidence(*shared.value)
        for b in batches:
            if b.num_rows:
                zero = np.zeros(b.num_rows, "i8")
                batch = Batch(b.column(b.schema.get_field_index("name")), zero, zero, zero, evid)
                at = np.flatnonzero((batch.most_bits() >= alone - TWO_PARTS)[batch.code])
                signature, own = batch.signature(NAME_ROWS * NAME_BANDS)[at], b.take(pa.array(at))
                for n, key in enumerate(_keys(zero[at] + NAME, signature, NAME_ROWS, NAME_BANDS)):
                    yield rows(key ^ np.uint64(n), NAME, own)

    placed = placed.unionByName(records.select(*fields).mapInArrow(band, schema))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evid = Evidence(*shared.value)
        for t in whole_blocks(batches, RANGE_ROWS):
            if (out := _links(t, evid, threshold)) is not None:
                yield out

    linked = placed.repartition(tasks(spark, known.n, ROWS_A_TASK), "block").sortWithinPartitions("block", F.col("packed") % 8, "person").mapInArrow(compare, "source int, a bigint, b bigint, " + PAIR)
    return settle(linked, counts, known, threshold)


def looked_at(n: int) -> float:
    """The margin for links that likely() may keep of n records: MARGIN in small tables, less where that is more than ENOUGH."""
    return float(min(MARGIN, max(LEAST_MARGIN, ENOUGH - np.log2(max(2, n)))))


def likely(links: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """The links with MARGIN, or with ENOUGH bits as long as these are more likely one person's than chance. sizes: records by source.

    What a birth date and common names say doesn't grow with n, so pairs that have the bits in a small
    table fall below log2(n) + MARGIN in a large one. But of all n * n / 2 pairs of a source's records
    as many as there are sure links are one person's at least, so log2(n * n / 2 / sure) bits are even
    odds, which is less where many records have a partner. Nothing that has MARGIN is left out.
    """
    most = float(np.log2(max(2, sum(sizes.values()))) + MARGIN)
    sure = links.groupBy("source").agg(F.count_if(F.col("bits") >= most).alias("sure")).collect()
    bars = {r["source"]: min(most, max(ENOUGH, float(2 * np.log2(sizes[r["source"]]) - 1 - np.log2(max(1, r["sure"]))))) for r in sure}
    return links.where(reduce(lambda x, y: x | y, [(F.col("source") == s) & (F.col("bits") >= bar) for s, bar in bars.items()], F.lit(False)))


def star_clusters(links: DataFrame) -> DataFrame:
    """Rows (key, center): the linked keys (a, b) in stars around centers.

    The free key with most links, ties by key, becomes a center and its free neighbours its star,
    over and over. Keys that come before all their free neighbours are centers at once, so a round
    settles them together; rounds repeat on what is left, and stop when no link between free keys is.
    """
    links = cut(links)
    both = links.select(F.col("a").alias("key"), F.col("b").alias("other"), "bits").unionByName(links.select(F.col("b").alias("key"), F.col("a").alias("other"), "bits"))
    degree = both.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    left = cut(both.join(degree, "key").join(degree.withColumnsRenamed({"key": "other", "n": "n_other"}), "other"))
    stars: list[DataFrame] = []
    while not left.isEmpty():
        before = (F.col("n_other") > F.col("n")) | ((F.col("n_other") == F.col("n")) & (F.col("other") > F.col("key")))
        centers = left.groupBy("key").agg(F.max(before).alias("later")).where("not later").select(F.col("key").alias("center"))
        near = left.join(centers, left["other"] == centers["center"], "left_semi")
        satellites = near.groupBy("key").agg(F.max_by("other", F.struct("bits", "other")).alias("center"))
        star = cut(satellites.unionByName(centers.select(F.col("center").alias("key"), "center")))
        stars.append(star)
        done = star.select("key")
        left = cut(left.join(done, "key", "left_anti").join(done.withColumnRenamed("key", "other"), "other", "left_anti"))
    if not stars:
        return left.select("key", F.col("other").alias("center"))
    return reduce(DataFrame.unionByName, stars)


def variants(records: DataFrame, margin: float | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Rows (source, key_1, key_2), key_1 < key_2: all pairs of keys in one cluster of one person's spellings.

    Linked is what likely() keeps; with a margin what has so many bits above log2 of the number of records.

    records as people() gives them; where they are numbered, keys has the (source, key) that the
    numbers stand for, so that only the keys of linked persons are looked up.

    Defined cases: keys without any name, or without birth date, e-mail address and postcode, are
    linked to nothing, unless all parts of a rare name are another's; equal records of one key are
    one; an empty table gives no rows; ties between centers go by number.
    """
    if keys is None:
        records = records.withColumn("person", number(F.col("source"), F.col("key")))
    # read several times; what is lost of it with an executor is made again from the table
    records = records.persist()
    try:
        keys = (records if keys is None else keys).select(number(F.col("source"), F.col("key")).alias("key"), "source", F.col("key").alias("name"))
        if margin is None:
            sizes = {r["source"]: r["count"] for r in records.groupBy("source").count().collect()}
            links = likely(cut(link(records, looked_at(sum(sizes.values())))), sizes)
        else:
            links = link(records, margin)
        stars = cut(star_clusters(links).join(keys, "key").select("source", "center", "name").distinct())
    finally:
        records.unpersist()
    one = stars.withColumnRenamed("name", "key_1")
    return one.join(stars.withColumnRenamed("name", "key_2"), ["source", "center"]).where("key_1 < key_2").select("source", "key_1", "key_2")
