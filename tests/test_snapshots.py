import random
from datetime import datetime

from pyspark.sql import functions as F

from tallywright.operators.snapshots import delta_counts, fingerprint, joined_map, map_text, snapshot_delta

SCHEMA = "row_id long, tenant string, run string, started timestamp, delivery int, k string, v string, m map<string,string>, detected_at timestamp, kind string, _key string"


def frame(spark, data):
    return spark.createDataFrame([(n, *r, "x", "y") for n, r in enumerate(data)], SCHEMA)


def delta(df):
    return snapshot_delta(df, "tenant", "run", "started", "delivery", F.col("k"), fingerprint(F.col("v"), map_text(F.col("m")))).select("run", "delta_key", "kind")


def t(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_kinds_deliveries_repeats_and_nulls(spark, rows):
    df = frame(
        spark,
        [
            ("t", "r1", t(1), 1, "stays", "1", {"a": "1", "b": None}, t(1)), ("t", "r1", t(1), 1, "goes", "1", None, t(1)), ("t", "r1", t(1), 1, "changes", "1", {}, t(1)), ("t", "r1", t(1), 1, None, "1", None, t(1)),
            ("t", "r2", t(2), 1, "goes", "1", None, t(2)),  # an earlier delivery doesn't count
            ("t", "r2", t(2), 2, "stays", "1", {"b": None, "a": "1"}, t(2)), ("t", "r2", t(2), 2, "changes", "1", None, t(2)), ("t", "r2", t(2), 2, "comes", "1", None, t(2)), ("t", "r2", t(2), 2, "comes", "1", None, t(2)), ("t", "r2", t(2), 2, None, None, None, t(2)),
            ("t", "r3", t(3), 1, "stays", "1", {"a": "1"}, t(3)), ("t", "r3", t(3), 1, "goes", "1", None, t(3)), ("t", "r3", t(3), 1, "changes", "2", None, t(3, 1)), ("t", "r3", t(3), 1, "changes", "1", None, t(3, 2)),
            ("u", "s1", t(9), None, "only", "1", None, None),
        ],
    )
    got = rows(delta(df))
    assert got == sorted(
        [
            ("r2", "goes", "resolved"), ("r2", "changes", "changed"), ("r2", "comes", "new"), ("r2", None, "changed"), ("r3", "stays", "changed"), ("r3", "goes", "new"), ("r3", "comes", "resolved"), ("r3", None, "resolved"),
        ],
        key=lambda r: tuple((x is not None, str(x)) for x in r),
    )
    assert rows(delta_counts(delta(df), "run")) == [("r2", 1, 1, 2), ("r3", 1, 2, 1)]


def test_empty(spark, rows):
    assert rows(delta(frame(spark, []))) == []


def test_map_texts(spark):
    df = spark.createDataFrame([({"b": "2", "a": None},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(joined_map(F.col("m"))).collect()] == ["a=|b=2", "", ""]
    assert len({r[0] for r in df.select(map_text(F.col("m"))).collect()}) == 3


def test_brute_force_with_a_hot_key(spark, rows):
    rng = random.Random(6)
    data = [(f"t{rng.randrange(3)}", None, None, 1, "hot" if rng.random() < 0.34 else f"k{rng.randrange(60)}", rng.choice("xy"), None, t(1 + rng.randrange(20))) for _ in range(3000)]
    data = [(a, f"{a}r{n % 5}", t(1 + n % 5), *rest) for n, (a, _, _, *rest) in enumerate(data)]
    snaps = {}
    for n, (tenant, run, _, _, k, v, _, at) in enumerate(data):
        s = snaps.setdefault((tenant, run), {})
        s[k] = max(s.get(k, (datetime(1, 1, 1), -1, "")), (at, n, v))
    want = []
    for tenant in {a for a, _ in snaps}:
        runs = sorted(r for a, r in snaps if a == tenant)
        for before, now in zip(runs, runs[1:], strict=False):
            p, c = snaps[tenant, before], snaps[tenant, now]
            want += [(now, k, "new") for k in c.keys() - p.keys()] + [(now, k, "resolved") for k in p.keys() - c.keys()] + [(now, k, "changed") for k in p.keys() & c.keys() if p[k][2] != c[k][2]]
    assert rows(delta(frame(spark, data))) == sorted(want)
