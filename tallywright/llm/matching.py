"""Matching records of people between sources that share no key: sorted neighbourhoods, weighted similarities, assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.persons import PAIR, PAIR_NAMES, Batch, Evidence, evidence, numbers, settle, tally, weigh
from tallywright.session import cut, tasks

#: Records a window spans, records compared at once, and records for a task.
WINDOW, RANGE_ROWS, ROWS_A_TASK = 16, 1 << 15, 250_000
#: Bits above log2 of the number of records that make a pair a match, and that make it one beyond doubt.
MARGIN, BEYOND_DOUBT = 4.0, 12.0
MIN_SHARE, MIN_OTHER = 0.3, -3.0
#: Bits of an address that differs, and number of sort keys.
DIFFERS, KEYS = -1.0, 5
#: Bits from which the records of two keys that want one partner speak for one person: more for than against.
AGREE = 1e-9
#: Bits by which a bid at least rises.
STEP = 0.25

_FIELDS = ["source", "key", "name", "born", "email", "post"]


def sort_keys(records: DataFrame) -> DataFrame:
    """The records once for each composite sort key (at), which begins with the key's number; keys whose leading field is unknown are left out.

    Each key leads by another field: birth date and surname, birth date and first name, all parts of
    the name in order, e-mail address, postcode. Two records of one person agree in at least one of
    them, but for what is typed wrong in the rest.
    """
    named = records.select(*_FIELDS, F.split("name", r"\|").alias("_n"))
    named = named.select(*_FIELDS, F.substring_index(F.get("_n", F.lit(0)), " ", 1).alias("_first"), F.translate(F.get("_n", F.lit(2)), " ", "").alias("_last"))
    ordered = F.array_join(F.sort_array(F.filter(F.split(F.translate("name", "|", " "), " "), lambda p: F.length(p) > 1)), "")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    leads = [("born", ["_last", "_first"]), ("born", ["_first", "_last"]), (None, ["born"]), ("email", ["_last", "_first"]), ("post", ["born", "_first"])]
    keys = []
    for n, (lead, rest) in enumerate(leads):
        first = F.nullif(ordered, F.lit("")) if lead is None else F.col(lead).cast("string")
        keys.append(F.when(first.isNotNull(), F.concat(F.lit(str(n)), first, *[x for c in rest for x in (F.lit("~"), text(c))])))
    return named.select(*_FIELDS, F.explode(F.array_compact(F.array(*keys))).alias("at"))


def _window_pairs(t: pa.Table, known: Evidence, threshold: float, crossing: np.ndarray | None = None) -> pa.RecordBatch:
    """The matches among neighbours in a sorted table. crossing: where given, only pairs across its change are compared."""
    batch = Batch(t["name"].combine_chunks(), numbers(t, "born"), numbers(t, "email"), numbers(t, "post"), known)
    source, turn = numbers(t, "source"), np.array(pc.utf8_slice_codeunits(t["at"], 0, 1).cast(pa.int32()))
    most = batch.most_bits()[batch.code]
    found_i, found_j = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
    for d in range(1, min(WINDOW, len(source))):
        i = np.flatnonzero((source[d:] != source[:-d]) & (turn[d:] == turn[:-d]))
        if crossing is not None:
            i = i[crossing[i] != crossing[i + d]]
        j = i + d
        # names can't give more than all their parts
        other = batch.dates(i, j) + batch.contact("email", i, j, DIFFERS) + batch.contact("post", i, j, DIFFERS)
        ok = (other >= MIN_OTHER) & (other + np.minimum(most[i], most[j]) >= threshold - 1e-6)
        i, j = i[ok], j[ok]
        mail = (batch.email[i] == batch.email[j]) & (batch.email[i] != 0)
        ok = mail | (batch.share(i, j) >= MIN_SHARE)
        found_i.append(i[ok])
        found_j.append(j[ok])
    w = weigh(batch, np.concatenate(found_i), np.concatenate(found_j), DIFFERS, DIFFERS)
    ok = np.flatnonzero(w.total >= threshold)
    i, j = w.i[ok], w.j[ok]
    a, b = np.where(source[i] == 0, i, j), np.where(source[i] == 0, j, i)
    key = t["key"].combine_chunks()
    return pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(b)), *w.columns(ok)], names=["a", "b", *PAIR_NAMES])


def most_keys(records: DataFrame) -> int:
    """How many different keys the larger source has, 2 at least."""
    return max(2, records.select("source", "key").distinct().groupBy("source").count().agg(F.max("count")).first()[0] or 0)


def candidates(records: DataFrame, margin: float = MARGIN, known: Evidence | None = None, counts: DataFrame | None = None, keys: int | None = None) -> DataFrame:
    """Rows (a, b, bits): keys of sources 0 and 1 whose records, in some window, are one person's by their evidence.

    records as people() gives them, of sources 0 and 1. They are range-sorted by each of several
    composite keys; a window slides over every order, and the records of the two sources in it are
    compared field by field: names by likeness of their parts, birth dates by parts, addresses. The
    weights are bits of evidence, by how rare a value is. The windows over the boundaries of
    partitions are compared in a second step. A value that many share makes no block: its records
    are sorted by the key's other fields, and the window moves on.
    """
    spark = records.sparkSession
    counts = tally(records) if counts is None else counts
    known = evidence(records, counts) if known is None else known
    threshold = float(np.log2(keys or most_keys(records)) + margin)
    shared = spark.sparkContext.broadcast((known.n, known.parts, known.born, known.email, known.post))
    sorted_rows = sort_keys(records).repartitionByRange(tasks(spark, known.n * KEYS, ROWS_A_TASK), "at", "key").sortWithinPartitions("at", "key").withColumn("pid", F.spark_partition_id())
    edge_fields = ["at", *_FIELDS]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    result = "a string, b string, " + PAIR.replace("email", "same_email").replace("post", "same_post") + ", edge int, half int, at string, source int, key string, name string, born int, email bigint, post bigint"
    names = ["a", "b", "bits", "same_email", "same_post", "words", "edge", "half", *edge_fields]

    def matches(found: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, k) for k in (pa.int32(), pa.int32(), *kinds)]], names=names)

    def edges(t: pa.Table, edge: int, half: int) -> pa.RecordBatch:
        n = t.num_rows
        none = [pa.nulls(n, k) for k in (pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*none, pa.array(np.full(n, edge, "i4")), pa.array(np.full(n, half, "i4")), *[t[c].combine_chunks() for c in edge_fields]], names=names)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Evidence(*shared.value)
        carried: pa.Table | None = None
        held: list[pa.RecordBatch] = []
        rows, pid = 0, None
        first = True

        def compared() -> Iterator[pa.RecordBatch]:
            nonlocal carried, held, rows, first
            t = pa.Table.from_batches(held).combine_chunks()
            if first:
                yield edges(t.slice(0, WINDOW - 1), pid, 1)
                first = False
            # pairs among the rows carried over were compared before; settling drops them
            t = t if carried is None else pa.concat_tables([carried, t]).combine_chunks()
            yield matches(_window_pairs(t, own, threshold))
            carried, held, rows = t.slice(max(0, t.num_rows - WINDOW + 1)), [], 0

        for batch in batches:
            if batch.num_rows:
                pid = batch.column(batch.schema.get_field_index("pid"))[0].as_py()
                held.append(batch)
                rows += batch.num_rows
                if rows >= RANGE_ROWS:
                    yield from compared()
        if rows:
            yield from compared()
        if carried is not None:
            yield edges(carried, pid + 1, 0)

    found = cut(sorted_rows.mapInArrow(slide, result))

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by([("half", "ascending"), ("at", "ascending"), ("key", "ascending")])
        return pa.Table.from_batches([_window_pairs(t, Evidence(*shared.value), threshold, t["half"].to_numpy())])

    seams = found.where("edge is not null").groupBy("edge").applyInArrow(across, "a string, b string, " + PAIR)
    pairs = found.where("edge is null").select("a", "b", "bits", F.col("same_email").alias("email"), F.col("same_post").alias("post"), "words").unionByName(seams)
    return settle(pairs, counts, known, threshold)


def _best(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.max_by(F.struct("b", "bits"), F.struct("bits", "b")).alias("x")).select("a", "x.b", "x.bits")


def entries(records: DataFrame, pairs: DataFrame, known: Evidence, counts: DataFrame) -> DataFrame:
    """Rows (a, holder): keys of source 0 whose best b is holder's best too, and whose own records speak for one person.

    holder is the a with most bits for that b, so every other a is compared once. Each pair of their
    records is weighed; contradictions, as of twins, speak against.
    """
    best = _best(pairs)
    held = best.groupBy("b").agg(F.max_by("a", F.struct("bits", "a")).alias("holder"))
    rivals = best.join(held, "b").where("a != holder").select("a", "holder")
    own = [c for c in _FIELDS if c not in ("source", "key")]
    of = lambda key, s: records.where("source = 0").select(F.col("key").alias(key), *[F.col(c).alias(f"{s}_{c}") for c in own])
    both = rivals.join(of("a", "x"), "a").join(of("holder", "y"), "holder")
    shared = records.sparkSession.sparkContext.broadcast((known.n, known.parts, known.born, known.email, known.post))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evid = Evidence(*shared.value)
        for b in batches:
            n, t = b.num_rows, pa.Table.from_batches([b])
            two = pa.table({c: pa.concat_arrays([t[f"{s}_{c}"].combine_chunks() for s in "xy"]) for c in own})
            batch = Batch(two["name"].combine_chunks(), numbers(two, "born"), numbers(two, "email"), numbers(two, "post"), evid)
            w = weigh(batch, np.arange(n), np.arange(n) + n)
            ok = np.flatnonzero(w.total >= AGREE)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("holder").take(pa.array(ok)), *w.columns(ok)], names=["a", "b", *PAIR_NAMES])

    agree = settle(both.mapInArrow(compare, "a string, b string, " + PAIR), counts, known, AGREE)
    return agree.select("a", F.col("b").alias("holder"))


def assign(pairs: DataFrame, threshold: float, one: DataFrame | None = None) -> DataFrame:
    """Rows (a, b, bits): each a at most once, each b for one person, so that the sum of bits is greatest.

    one has rows (a, holder), the a that are entries of holder's person. Pairs beyond doubt (bits >=
    threshold) that are their a's best are settled first, and there a b may have several a, the
    entries of one person; so may entries of a holder that is settled. For the rest an auction is
    held between persons: every free person bids for its best b, up to what this is better than its
    second best; a b goes to the highest bid and frees the person that held it. The auction ends when
    none bids, within STEP per pair of the greatest sum. Ties go by key. All entries of a person get
    its b; those without a pair of their own with it have the person's bits.
    """
    pairs = cut(pairs)
    best = _best(pairs)
    sure = best.where(F.col("bits") >= threshold)
    if one is not None:
        one = cut(one)
        # an entry of a settled holder has the same best b, whatever its bits
        settled = one.join(sure.select(F.col("a").alias("holder")), "holder", "left_semi").select("a")
        sure = sure.unionByName(best.join(settled, "a", "left_semi")).distinct()
    sure = cut(sure)
    left = pairs.join(sure.select("a"), "a", "left_anti").join(sure.select("b").distinct(), "b", "left_anti")
    if one is not None:
        left = left.join(one, "a", "left").groupBy(F.coalesce("holder", "a").alias("a"), "b").agg(F.max("bits").alias("bits"))
    left = cut(left)
    held = left.select("b", F.lit(0.0).alias("price"), "a", "bits").limit(0)
    while True:
        offers = left.join(held.select("a"), "a", "left_anti").join(held.select("b", "price"), "b", "left")
        offers = offers.select("a", "b", "bits", (F.col("bits") - F.coalesce("price", F.lit(0.0))).alias("net")).where("net > 0")
        ranked = offers.groupBy("a").agg(F.max_by(F.struct("b", "bits", "net"), F.struct("net", "b")).alias("x"), F.get(F.sort_array(F.collect_list("net"), False), F.lit(1)).alias("second"))
        bids = ranked.select("a", "x.b", "x.bits", (F.col("x.bits") - F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0)) + STEP).alias("price"))
        won = cut(bids.groupBy("b").agg(F.max_by(F.struct("price", "a", "bits"), F.struct("price", "a")).alias("x")).select("b", "x.price", "x.a", "x.bits"))
        if won.isEmpty():
            break
        held = cut(held.join(won.select("b"), "b", "left_anti").unionByName(won))
    held = held.select("a", "b", "bits")
    if one is not None:
        more = one.join(sure, "a", "left_anti").join(held.withColumnRenamed("a", "holder"), "holder")
        own = pairs.withColumnRenamed("bits", "own")
        held = held.unionByName(more.select("a", "b", "bits")).join(own, ["a", "b"], "left").select("a", "b", F.coalesce("own", "bits").alias("bits"))
    return sure.select("a", "b", "bits").unionByName(held)


def match(records: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Rows (a, b, bits, confidence): the cross-reference of keys of source 0 to keys of source 1.

    confidence is the probability of a match that the bits give, at one true partner among all records.

    Defined cases: records without any name are matched to nothing; null fields say nothing for or
    against; several keys of one person all get its partner; repeated records are one; a table that is empty gives no rows; ties go by key.
    """
    # read several times; what is lost of it with an executor is made again from the table
    records = records.persist()
    try:
        n = most_keys(records)
        counts = tally(records)
        known = evidence(records, counts)
        pairs = cut(candidates(records, margin, known, counts, n))
        out = assign(pairs, float(np.log2(n)) + BEYOND_DOUBT, entries(records, pairs, known, counts))
    finally:
        records.unpersist()
    return out.withColumn("confidence", 1 / (1 + F.pow(F.lit(2.0), F.lit(float(np.log2(n))) - F.col("bits"))))
