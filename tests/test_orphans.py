import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.functions.values import numbered_key, uuid_key
from tallywright.operators import orphans as O
from tallywright.operators.orphans import Reference, orphan_counts, orphans

PARENT, CHILD = "key string, live boolean, loaded_at timestamp, kind string, ref int", "row_id long, key string, loaded_at timestamp, kind string, period int"


def reference(spark, parents, children, name="child"):
    p = spark.createDataFrame([(*r, "x", 1) for r in parents], PARENT)
    c = spark.createDataFrame([(n, *r, "x", 1) for n, r in enumerate(children)], CHILD)
    return Reference(name, c, F.col("key"), p, F.col("key"), F.col("live"))


def t(month, day=1):
    return datetime(2024, month, day)


def test_kinds(spark, rows):
    parents = [("ok", True, t(1)), ("ok", False, t(5)), ("dead", False, t(1)), ("late", True, t(6)), ("same", True, t(3, 10)), ("old", True, t(1)), ("old", True, t(9)), (None, True, t(1)), ("untimed", True, None), ("odd", None, t(1))]
    children = [("ok", t(2)), ("gone", t(2)), ("gone", t(2)), ("gone", None), ("dead", t(2)), ("late", t(2)), ("late", None), ("late", t(7)), ("same", t(3, 9)), ("same", t(3, 11)), ("old", t(2)), (None, t(2)), ("untimed", t(1)), ("odd", t(2))]
    found = orphans([reference(spark, parents, children), reference(spark, [], [("ok", t(2))], "other")])
    assert rows(found.select("child_table", "row_id", "kind")) == [("child", 1, "missing"), ("child", 13, "deleted"), ("child", 2, "missing"), ("child", 3, "missing"), ("child", 4, "deleted"), ("child", 5, "late"), ("child", 8, "late"), ("other", 0, "missing")]
    assert ("child", None, "missing", 1) in rows(orphan_counts(found)) and ("child", "2024-02", "missing", 2) in rows(orphan_counts(found))


def test_empty(spark, rows):
    assert rows(orphans([reference(spark, [], [])])) == []


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 5000):
        a, b = np.flatnonzero(rng.random(n) < 0.3), np.flatnonzero(rng.random(n) < 0.5)
        assert O._and_not(O._bitmap(a, n), O._bitmap(b, n)).tolist() == sorted(set(a.tolist()) - set(b.tolist()))


@pytest.mark.parametrize("range_rows", [7, 1 << 16])
def test_brute_force_with_a_hot_missing_key(spark, rows, monkeypatch, range_rows):
    monkeypatch.setattr(O, "RANGE_ROWS", range_rows)
    rng = random.Random(7)
    when = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(4000))
    parents = [(f"k{rng.randrange(300)}", rng.random() < 0.7, when()) for _ in range(400)]
    children = [("none" if rng.random() < 0.34 else f"k{rng.randrange(350)}", when()) for _ in range(2000)]
    want = []
    for n, (k, at) in enumerate(children):
        own = [(live, first) for key, live, first in parents if key == k]
        kind = "missing" if not own else "deleted" if not any(live for live, _ in own) else "late" if min(f for _, f in own) > at else None
        if kind:
            want.append(("child", n, kind))
    got = rows(orphans([reference(spark, parents, children)]).select("child_table", "row_id", "kind"))
    assert sorted(got) == sorted(want)


def test_keys(spark):
    df = spark.createDataFrame([("{9DA6-2C} ", "s-001 23"), (None, "S000"), ("a", "TBC 7")], "u string, n string")
    assert [tuple(r) for r in df.select(uuid_key(F.col("u")), numbered_key(F.col("n"))).collect()] == [("9da6-2c", "S123"), (None, "S0"), ("a", "TBC7")]


def test_many_references_and_hot_ones_give_the_same(spark, monkeypatch):
    rows = [(n, str(n % 7) if n % 2 else "hot", "2024-01-05") for n in range(400)] + [(1000 + n, "good", "2024-02-05") for n in range(200)]
    child = spark.createDataFrame(rows, "row_id long, k string, loaded_at string")
    parent = spark.createDataFrame([("3", "2024-01-01"), ("good", "2023-01-01")], "p string, loaded_at string")
    make = lambda: [O.Reference("c", child, F.col("k"), parent, F.col("p"), F.lit(True))]
    few = sorted(map(tuple, O.orphans(make()).collect()))
    monkeypatch.setattr(O, "BROADCAST_ROWS", 2)
    many = sorted(map(tuple, O.orphans(make()).collect()))
    monkeypatch.setattr(O, "HOT", 50)
    assert len(few) > 300 and few == many == sorted(map(tuple, O.orphans(make()).collect()))
