import random
from datetime import datetime

import pytest

from tallywright.operators.diff import diff_copies

SCHEMA = "row_id long, side string, entity string, id string, fields map<string,string>, projected_at timestamp, status string, _side string"
KINDS = {"born": "date", "fee": "number", "active": "boolean"}


def frame(spark, data):
    return spark.createDataFrame([(n, *r, "x", "y") for n, r in enumerate(data)], SCHEMA)


def t(day):
    return datetime(2024, 1, day)


@pytest.mark.parametrize(
    ("field", "a", "b", "status"),
    [
        ("born", "2004-03-05", "05/03/2004", None), ("born", "2004-03-05T00:00:00", "05-MAR-2004", None), ("born", "2004-03-05", "03/05/2004", "mismatch"), ("born", "2004-02-30", "2004-02-30 ", None),
        ("fee", "£9,250.00", "9250", None), ("fee", "9250", "925000", "mismatch"), ("fee", "n/a", "9250", "mismatch"), ("active", "Y", "true", None), ("active", "0", "Yes", "mismatch"),
        ("name", " José  Luis", "josé luis ", None), ("name", "José", "Jose", "mismatch"), ("name", "O'Neil", "ONeil", "mismatch"), ("code", "007", "7", "mismatch"), ("code", "ab", "AB ", None),
        ("name", "", "x", "null-in-a"), ("name", None, "x", "null-in-a"), ("name", "x", "  ", "null-in-b"), ("name", "", None, None), ("name", "STRASSE", "straße", None), ("name", "x" * 200_000, "x" * 200_000 + "y", "mismatch"),
    ],
)
def test_values(spark, rows, field, a, b, status):
    df = frame(spark, [("a", "e", "1", {field: a}, t(1)), ("b", "e", "1", {field: b}, t(1))])
    assert rows(diff_copies(df, ["entity", "id"], kinds=KINDS)) == ([("e", "1", field, status)] if status else [])


def test_records_versions_and_nulls(spark, rows):
    df = frame(
        spark,
        [
            ("a", "e", "1", {"n": "old"}, t(1)), ("a", "e", "1", {"n": "new"}, t(2)), ("a", "e", "1", {"n": "none"}, None), ("b", "e", "1", {"n": "new"}, t(1)), ("b", "e", "1", {"n": "new"}, t(1)),
            ("a", "e", "2", None, t(1)), ("b", "e", "2", {"n": "v", "m": None}, t(1)), ("a", "e", "3", {}, t(1)), ("b", None, "4", {"n": "v"}, t(1)), ("b", "e", None, {"n": "v"}, t(1)), ("a", "e", None, {"n": "w"}, t(1)),
            ("c", "e", "9", {"n": "v"}, t(1)), (None, "e", "9", {"n": "v"}, t(1)), ("a", "e", "5", {"n": "tie"}, t(1)), ("a", "e", "5", {"n": "last"}, t(1)), ("b", "e", "5", {"n": "last"}, t(1)),
        ],
    )
    assert rows(diff_copies(df, ["entity", "id"])) == [(None, "4", "<record>", "missing-in-a"), ("e", None, "n", "mismatch"), ("e", "2", "n", "null-in-a"), ("e", "3", "<record>", "missing-in-b")]


def test_empty_and_other_names_of_sides(spark, rows):
    assert rows(diff_copies(frame(spark, []), ["entity", "id"])) == []
    df = frame(spark, [("z", "e", "1", {"n": ""}, t(1)), ("b", "e", "1", {"n": "1"}, t(1)), ("z", "e", "2", {}, t(1))])
    assert rows(diff_copies(df, ["entity", "id"], sides=("z", "b"))) == [("e", "1", "n", "null-in-z"), ("e", "2", "<record>", "missing-in-b")]


def test_one_key_holds_a_third_and_brute_force(spark, rows):
    rng = random.Random(4)
    data = [(rng.choice("ab"), "e", "hot" if rng.random() < 0.34 else str(rng.randrange(300)), {f: rng.choice(["", "x", "X", "y", None]) for f in ("p", "q")}, t(1 + rng.randrange(9))) for _ in range(3000)]
    latest = {}
    for n, (side, _, key, fields, at) in enumerate(data):
        latest[side, key] = max(latest.get((side, key), (datetime(1, 1, 1), -1, {})), (at, n, fields), key=lambda v: v[:2])
    want = []
    for key in {k for _, k in latest}:
        a, b = latest.get(("a", key)), latest.get(("b", key))
        if not a or not b:
            want.append(("e", key, "<record>", f"missing-in-{'b' if a else 'a'}"))
            continue
        for f in ("p", "q"):
            x, y = ((v[2][f] or "").lower() for v in (a, b))
            if x != y:
                want.append(("e", key, f, "null-in-a" if not x else "null-in-b" if not y else "mismatch"))
    assert rows(diff_copies(frame(spark, data), ["entity", "id"])) == sorted(want)
