import random
from datetime import date

from pyspark.sql import functions as F

from tallywright.operators.profile import FILLER_CODES, column_values, is_missing, prefix_sums, profile

SCHEMA = "tenant_id string, load_id long, load_date date, v string, measure double, n int"


def values(spark, data):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in data], SCHEMA)
    v = F.col("v")
    return column_values(df, "c", "tenant_id", "load_id", "load_date", v, is_missing(v, FILLER_CODES), v.rlike(r"^\d{3}$"), v.try_cast("double"), v.try_cast("double") > 900)


def test_rates_and_changes(spark):
    a, b = ("t", 1, date(2024, 1, 1)), ("t", 2, date(2024, 2, 1))
    rows = [(*a, x) for x in ("100", "100", "200", "300", None, " ", "N/A", "999", "zz9")] + [(*b, x) for x in ("100", "400", "950", "400", "400")] + [("u", 3, date(2024, 1, 5), None)]
    got = {r["load_id"]: r for r in profile(values(spark, rows)).collect()}
    r = got[1]
    assert (r["rows"], r["missing"], r["ill_formed"], r["well_formed"], r["distinct"], r["low"], r["high"], r["median"], r["heap"], r["previous_load"], r["ks"]) == (9, 4, 1, 4, 3, 100, 300, 150, 0.5, None, None)
    r = got[2]
    assert (r["median"], r["median_before"], r["previous_load"], r["out_of_range"]) == (400, 150, 1, 1)
    assert abs(r["ks"] - 0.8) < 1e-12 and abs(r["tv"] - 0.8) < 1e-12
    r = got[3]
    assert (r["rows"], r["missing"], r["distinct"], r["median"], r["ks"], r["heap"]) == (1, 1, 0, None, None, None)


def test_empty(spark):
    assert profile(values(spark, [])).collect() == []


def test_against_plain_statistics(spark):
    rng = random.Random(8)
    data = [("t", n, date(2024, 1, 1 + n), "500" if rng.random() < 0.34 else f"{rng.randrange(100, 300):03d}") for n in range(4) for _ in range(rng.randrange(5, 400))]
    by = {n: sorted(int(v) for _, k, _, v in data if k == n) for n in range(4)}
    for r in profile(values(spark, data)).collect():
        x = by[r["load_id"]]
        assert r["median"] == (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 and r["distinct"] == len(set(x))
        if r["load_id"]:
            y = by[r["load_id"] - 1]
            share = lambda s, v: sum(i <= v for i in s) / len(s)
            assert abs(r["ks"] - max(abs(share(x, v) - share(y, v)) for v in {*x, *y})) < 1e-9
            assert abs(r["tv"] - sum(abs(x.count(v) / len(x) - y.count(v) / len(y)) for v in {*x, *y}) / 2) < 1e-9


def test_prefix_sums_over_partitions(spark):
    rng = random.Random(9)
    data = [("big" if rng.random() < 0.6 else f"g{rng.randrange(5)}", n, rng.randrange(10)) for n in range(3000)]
    df = spark.createDataFrame(data, "g string, o int, w int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["o"]): r["w_upto"] for r in prefix_sums(df, "g", ["o"], ["w"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums: dict = {}
    for g, o, w in sorted(data, key=lambda r: r[:2]):
        sums[g] = sums.get(g, 0) + w
        assert got[g, o] == sums[g]
