import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import reconcile as R

ALT = "array<struct<system:string,type:string,value:string>>"


def table_osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_and_similarity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(40)]
    assert all(R.osa(a, b, 9) == table_osa(a, b) and R.osa(a, b, 1) == min(2, table_osa(a, b)) for a in words for b in words)
    rows = [("Smith", "SMTIH"), ("ca", "abc"), ("", ""), (None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(R.edits(F.col("a"), F.col("b"), 5).alias("d"), R.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["d"] for r in got] == [1, 3, 0, None] and [r["s"] for r in got] == [pytest.approx(0.8), 0.0, 1.0, None]


@pytest.mark.parametrize("limit", [1, 2])
def test_near_texts_share_a_key(spark, limit):
    rng = random.Random(limit)
    rows = []
    for _ in range(150):
        a = [rng.choice("abcdef") for _ in range(rng.choice([1, 3, 8, 57, 58, 59, 60, 61, 62, 63, 90]))]
        b = list(a)
        for _ in range(limit):
            at, kind = rng.randrange(len(b) + 1), rng.randrange(4)
            if kind == 0:
                b.insert(at, rng.choice("abcxyz"))
            elif kind == 1 and at < len(b) > 1:
                del b[at]
            elif kind == 2 and at < len(b):
                b[at] = "x"
            elif at + 1 < len(b):
                b[at], b[at + 1] = b[at + 1], b[at]
        if table_osa(a, b) <= limit:
            rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    assert len(rows) > 100 and df.where(~F.arrays_overlap(R.near_keys(F.col("a"), limit), R.near_keys(F.col("b"), limit))).count() == 0


def test_alternate_ids(spark):
    rows = [(1, "x", [("crm", "n", "A1")]), (2, None, [("crm", "n", "a1"), ("web", "w", "q")]), (3, "", None), (4, "y", [])]
    a = spark.createDataFrame(rows, f"id long, e string, alt {ALT}")
    b = spark.createDataFrame([(7, " X ", [("CRM", "n", "a1")]), (8, "z", [("crm", "n", "a1"), ("web", "w", "Q")]), (9, None, None)], f"id long, e string, alt {ALT}")
    got = {(r["a_id"], r["b_id"]): r["reasons"] for r in R.match_exact(a, b, ["e"], "id", "id", "alt").collect()}
    assert got == {(1, 7): "e", (1, 8): "altid", (2, 8): "altid"}
    classes = {(r["side"], r["id"], r["reason"]): r["links"] for r in R.exact_classes(a, b, ["e"], "id", "id", "alt").where("value <> 'web|w|q'").collect()}
    assert classes == {("a", 1, "e"): 1, ("b", 7, "e"): 1, ("a", 1, "altid"): 1, ("a", 2, "altid"): 1, ("b", 8, "altid"): 2}
    assert R.exact_classes(a.limit(0), b, ["e"], "id", "id").count() == 0


def test_fuzzy_with_alternate_ids_and_two_edits(spark):
    schema = f"id long, l string, f string, d string, e string, alt {ALT}"
    alt = [("crm", "n", "1")]
    a = spark.createDataFrame([(1, "Marwood", "Ann", "1", None, alt), (2, "Penhallow", "Bob", "2", "b@x", None), (3, "Oakwell", "Cy", "3", None, alt)], schema)
    b = spark.createDataFrame([(7, "Marwood", "Zoe", "9", None, alt), (8, "Pehnalow", "Bob", "2", "b@x", None), (9, "Zutubo", "Di", "3", None, alt)], schema)
    got = {(r["a_id"], r["b_id"]): (round(r["score"], 9), r["kind"]) for r in R.match_fuzzy(a, b, "id", "id", "l", "f", "d", "e", limit=2, alternate="alt").collect()}
    assert got == {(1, 7): (0.55, "review"), (2, 8): (0.9, "confident"), (3, 9): (0.62, "review")}
    assert (2, 8) in {(r["a_id"], r["b_id"]) for r in R.match_fuzzy(a, b, "id", "id", "l", "f", "d", "e").where("kind = 'review'").collect()}


def test_classes_of_scores(spark):
    rows = [(0.55, []), (0.54, []), (0.7, []), (0.8, []), (0.79, []), (0.7, ["altid"]), (0.7, ["ownStuId"])]
    df = spark.createDataFrame(rows, "s double, r array<string>")
    assert [r[0] for r in df.select(R.classify(F.col("s"), F.col("r"), "fuzzy", 0.7)).collect()] == ["review", "rejected", "review", "confident", "review", "confident", "review"]
    assert df.limit(1).select(R.classify(F.lit(1.0), F.col("r"), "institutional", 1.0)).first()[0] == "confident"


def test_report_and_log(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", None), (3, "z", "q")], "id long, l string, p string")
    b = spark.createDataFrame([(7, "X ", "r"), (8, "y", "s")], "id long, l string, p string")
    pairs = spark.createDataFrame([(1, 7, 0.9, "confident"), (2, 8, 0.6, "review")], "a_id long, b_id long, score double, kind string")
    fields = {"name": ("l", "l"), "post": ("p", "p")}
    assert [tuple(r) for r in R.conflicts(pairs, a, b, "id", "id", fields).collect()] == [(1, 7, "post", "p", "r")]
    assert R.reconciliation_report(pairs, a, b, "id", "id", fields).first().asDict() == {"matched": 2, "a_only": 1, "b_only": 0, "conflicting": 1, "total_a": 3, "total_b": 2}
    assert R.reconciliation_report(pairs.limit(0), a, b.limit(0), "id", "id", fields).first()["b_only"] == 0
    log = R.merge_log(pairs, F.lit("merge"), "me", F.lit("2024-01-01"))
    assert log.select("entry_id").distinct().count() == 2 and set(log.columns) >= {"decision", "decided_by"}
