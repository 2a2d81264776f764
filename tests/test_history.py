import random

from pyspark.sql import functions as F

from tallywright.operators.history import change_log, history

SCHEMA = "k string, at string, a string, b string, until string, ord int, valid_from string, _key string"


def frame(spark, data):
    return spark.createDataFrame([(*r, n, "x", "y") for n, r in enumerate(data)], SCHEMA)


def test_updates(spark, rows):
    df = frame(
        spark,
        [
            ("p", "2020", "x", None, None), ("p", "2021", "x", None, None), ("p", "2022", "y", None, None), ("p", "2022", "z", None, None), ("p", "2023", None, None, None), ("p", "2024", None, "q", None),
            ("q", "2020", None, None, None), (None, "2020", "x", "x", None), ("r", None, "x", "x", None),
        ],
    )
    got = rows(history(df, "k", "at", ["a", "b"], ["ord"], F.lit("9999")))
    assert got == [("p", "2020", "2022", "x", None), ("p", "2022", "2023", "z", None), ("p", "2023", "2024", None, None), ("p", "2024", "9999", None, "q"), ("q", "2020", "9999", None, None)]


def test_periods(spark, rows):
    df = frame(
        spark,
        [
            ("gap", "10", "x", None, "20"), ("gap", "30", "x", None, None), ("touch", "10", "x", None, "20"), ("touch", "20", "x", None, "30"), ("over", "10", "x", None, "50"), ("over", "30", "y", None, "40"),
            ("turned", "30", "x", None, "20"), ("turned", "30", "x", None, "30"), ("same", "10", "x", None, "20"), ("same", "10", "y", None, "15"), ("same", "10", "z", None, "05"),
        ],
    )
    got = rows(history(df, "k", "at", ["a"], ["ord"], F.lit("99"), end="until"))
    assert got == [("gap", "10", "20", "x"), ("gap", "30", "99", "x"), ("over", "10", "30", "x"), ("over", "30", "40", "y"), ("same", "10", "15", "y"), ("touch", "10", "30", "x")]


def test_empty(spark, rows):
    assert rows(history(frame(spark, []), "k", "at", ["a"], ["ord"], F.lit("99"))) == []
    assert rows(history(frame(spark, []), "k", "at", ["a"], ["ord"], F.lit("99"), end="until")) == []


def test_the_log_has_only_changes(spark, rows):
    df = spark.createDataFrame([("p", "1", "x", "u"), ("p", "2", "x", "v"), ("p", "3", "y", "v")], "k string, at string, a string, b string")
    assert rows(change_log(df, "k", "at", ["a", "b"]).select("k", "at", "attribute", "held.value")) == [("p", "1", 0, "x"), ("p", "1", 1, "u"), ("p", "2", 1, "v"), ("p", "3", 0, "y")]


def test_brute_force(spark, rows):
    rng = random.Random(5)
    data = [(rng.choice(["hot", *map(str, range(40))]) if rng.random() > 0.3 else "hot", f"{rng.randrange(60):02d}", rng.choice(["x", "y", None]), rng.choice(["u", None]), None) for _ in range(2000)]
    data = [(k, a, x, y, f"{int(a) + rng.randrange(-3, 12):02d}" if rng.random() < 0.8 else None) for k, a, x, y, _ in data]
    for end in (None, "until"):
        kept = {}
        for n, (k, at, a, b, until) in enumerate(data):
            if not end or (until or "99") > at:
                kept[k, at] = (n, a, b, until or "99")
        want = []
        for key in {k for k, _ in kept}:
            times = sorted(at for k, at in kept if k == key)
            versions = []
            for n, at in enumerate(times):
                _, a, b, until = kept[key, at]
                stop = times[n + 1] if n + 1 < len(times) else "99"
                stop = min(stop, until) if end else stop
                if versions and versions[-1][3:] == (a, b) and versions[-1][2] == at:
                    versions[-1] = (key, versions[-1][1], stop, a, b)
                else:
                    versions.append((key, at, stop, a, b))
            want += versions
        got = rows(history(frame(spark, data), "k", "at", ["a", "b"], ["ord"], F.lit("99"), end=end))
        assert sorted(got, key=str) == sorted(want, key=str)
