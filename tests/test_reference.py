import json
import random
import urllib.error
from email.message import Message

import pytest
from pyspark.sql import functions as F

from tallywright.functions import text as X
from tallywright.operators import codes, findings, mapping, migrate, reconcile, verify
from tallywright.sinks import load
from tallywright.sources import files, paged
from tallywright.streaming import incremental


def test_near_is_one_edit_or_exchange(spark):
    pairs = [("smith", "smith", True), ("smith", "smtih", True), ("smyth", "smith", True), ("smit", "smith", True), ("ca", "abc", False), ("abcd", "badc", False), ("", "a", True), ("", "", True), ("ab", "ba", True), ("abc", "cba", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert [r[0] for r in df.select(reconcile.near(F.col("a"), F.col("b"))).collect()] == [w for *_, w in pairs]


@pytest.mark.parametrize("many", [0, 20, 100_000])
def test_fuzzy_joins_lose_no_pair(spark, monkeypatch, many):
    monkeypatch.setattr(reconcile, "MANY", many)
    rng = random.Random(11)
    make = lambda: (rng.choice(["smith", "smyth", "jones", None]), rng.choice(["ann", "anne", "bob"]), rng.choice(["1", "2", "3", None]), rng.choice(["x", "y", "z", ""]))
    a, b = [(n, *make()) for n in range(40)], [(n, *make()) for n in range(40)]
    schema = "id long, l string, f string, d string, e string"
    got = {(r["a_id"], r["b_id"]): (round(r["score"], 9), r["kind"]) for r in reconcile.match_fuzzy(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", "id", "l", "f", "d", "e").collect()}
    one = {("smith", "smyth"), ("ann", "anne")}
    want = {}
    for i, *x in a:
        for j, *y in b:
            s = 0.0
            for n, w in ((0, (0.35, 0.25)), (1, (0.20, 0.12))):
                if x[n] and y[n]:
                    s += w[0] if x[n] == y[n] else w[1] if tuple(sorted((x[n], y[n]))) in one else 0
            s += 0.30 if x[2] and x[2] == y[2] else 0
            s += 0.15 if x[3] and x[3] == y[3] else 0
            s = min(1.0, s)
            if s >= 0.7 - 0.15:
                want[i, j] = (round(s, 9), "confident" if s >= 0.7 + 0.1 else "review")
    assert got == want
    with pytest.raises(ValueError, match="threshold"):
        reconcile.match_fuzzy(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", "id", "l", "f", "d", "e", 0.5)


def test_one_to_one_is_the_greedy_scan(spark):
    rng = random.Random(12)
    pairs = [(i, j, rng.choice([0.6, 0.7, 0.8, 0.9])) for i in range(30) for j in range(30) if rng.random() < 0.2]
    used_a, used_b, want = set(), set(), set()
    for i, j, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            want.add((i, j, s))
    df = spark.createDataFrame(pairs, "a_id long, b_id long, score double")
    assert {tuple(r) for r in reconcile.one_to_one(df).collect()} == want
    assert reconcile.one_to_one(df.limit(0)).count() == 0


def test_hash_and_numbers(spark):
    def h(s):
        x = 0
        for c in s:
            x = (x * 31 + ord(c)) & 0xFFFFFFFF
        return x - (1 << 32) if x >= 1 << 31 else x

    texts = ["CS|1|202410", "", "a", "z" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(migrate.text_hash(F.col("t"))).collect()] == [h(t) for t in texts]
    assert h("CS|1|202410") == -696467626
    assert [r[0] for r in spark.createDataFrame([("12",), ("123456",)], "t string").select(migrate.pad(F.col("t"), 5)).collect()] == ["00012", "123456"]
    got = [r["number"] for r in migrate.number_rows(spark.range(1000).repartition(7), ["id"], 5, 4).orderBy("id").collect()]
    assert got == [f"{n:04d}" for n in range(5, 1005)]
    assert [r[0] for r in spark.createDataFrame([("202410",), ("x",), (None,)], "t string").select(migrate.term_year(F.col("t"))).collect()] == ["2024/5", None, None]


def test_stage_and_rollback(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "T"), (2, " ", "T"), (3, "c", "U")], "k long, v string, entity string")
    staged = migrate.stage(df, "k", ["v"], df.where("k = 3"))
    assert [(r["k"], r["op"], r["reason"]) for r in staged.orderBy("k").collect()] == [(1, "create", ""), (2, "skip", "missing v"), (3, "update", "")]
    migrate.commit(staged, str(tmp_path / "t"), "entity")
    written = spark.read.parquet(str(tmp_path / "t"))
    assert written.count() == 2 and migrate.rollback(written, df.where("k = 1"), "k").count() == 1
    assert migrate.stage(df, "k", ["v"], dry_run=True).where("op = 'skip'").count() == 3


def test_translate_prefers_the_tenant_and_keeps_rows(spark):
    maps = spark.createDataFrame([(1, "a", "general", None, None, None), (2, "a", "own", "2020", None, "t"), (3, "b", "old", None, "2010", None)], "entry_id long, sourcecode string, targetcode string, activefrom string, activeto string, tenantid string")
    rows = spark.createDataFrame([(1, "a", "t"), (2, "a", "u"), (3, "b", "t"), (4, None, "t"), (4, None, "t")], "id long, code string, tenant string")
    got = sorted((r["id"], r["target"] or "") for r in codes.translate(rows, "code", maps, F.lit("2021"), F.col("tenant")).collect())
    assert got == [(1, "own"), (2, "general"), (3, ""), (4, ""), (4, "")]
    assert codes.coverage(rows, "code", maps).collect()[0][:] == (2, 2, "", 1.0)


def test_verify_and_prep(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", ""), (3, "z", "q")], "k long, v string, w string")
    b = spark.createDataFrame([(1, "x", ""), (2, "Y", ""), (4, "z", "q")], "k long, v string, w string")
    got = sorted(tuple(r) for r in verify.verify_fields(a, b, "k", ["v", "w"]).collect())
    assert got == [(1, "v", "match"), (1, "w", "mismatch"), (2, "v", "mismatch"), (2, "w", "match"), (3, "<record>", "missing-in-b"), (4, "<record>", "missing-in-a")]
    assert ("w", "match") in {tuple(r)[1:] for r in verify.verify_fields(a, b, "k", ["v", "w"], True).where("k = 1").collect()}
    source = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n"), (9, "r")], "k long, v string")
    target = spark.createDataFrame([(1, "x", 1), (2, "q", 1), (2, "y2", 2)], "k long, v string, o int")
    got = sorted((str(r["k"]), r["verdict"], r["deltas"]) for r in verify.prep_verdicts(source, target, "k", ["v"], F.col("k") == 9, "o").collect())
    assert got == [("1", "skip", ""), ("2", "update", "v"), ("3", "create", ""), ("9", "reject", ""), ("None", "skip", "")]


def test_waivers(spark):
    d = spark.createDataFrame([("f", 1, "revoke", None, "2024-01-05", "2024-01-01"), ("f", 2, "waive", " ", "2024-01-05", "2024-01-01"), ("g", 1, "waive", "ok", "2024-01-01", "2024-01-01"), ("h", 1, "waive", "ok", "2024-01-09", "2024-01-01"), ("h", 2, "revoke", None, None, "2024-01-02"), ("h", 3, "revoke", None, None, "2024-01-03")], "f string, n int, kind string, reason string, waived_until string, decided_at string")
    got = {(r["f"], r["n"]): r["refused"] for r in findings.valid_decisions(d, "f", "n").collect()}
    assert got == {("f", 1): "nothing to revoke", ("f", 2): "no reason", ("g", 1): "no end after the decision", ("h", 1): None, ("h", 2): None, ("h", 3): "nothing to revoke"}


def test_redaction_and_check_digit(spark):
    df = spark.createDataFrame([("mail a.b@x.org or 01632 960761, NHS 943 476 5919, EC1A 1BB, AB123456C, GB1234567",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.redact(F.col("t"))).collect()] == ["mail [EMAIL] or [PHONE], NHS [NHS_NUMBER], [POSTCODE], [NI_NUMBER], [PASSPORT]", None, ""]
    # 2*9 + 1*4 = 22, a multiple of 11; with 1*9 the rest is 9, so the digit is 2; 1*1 gives 10, which no digit is
    assert [r[0] for r in spark.createDataFrame([("2000010000000",), ("1000000000000",), ("0000000010000",), ("12",), (None,)], "t string").select(X.check_digit(F.col("t"))).collect()] == [0, 2, None, None, None]


def test_embedding_and_nearest(spark):
    df = spark.createDataFrame([(1, "Student name"), (2, "student NAME"), (3, ""), (4, None), (5, "fee")], "k long, t string")
    e = {r["k"]: r["embedding"] for r in mapping.embed(df, "k", "t").collect()}
    assert e[1] == e[2] and sum(e[3]) == 0 and abs(sum(x * x for x in e[5]) - 1) < 1e-5
    got = mapping.nearest(mapping.embed(df, "k", "t").where("k = 1"), mapping.embed(df, "k", "t"), "k", "embedding", 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
    v = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0, 9.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in v.select(mapping.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_nearest_by_groups_is_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(300)] + [(999, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    near = lambda: sorted((r["query_id"], r["rank"], r["id"]) for r in mapping.nearest(v.where("id % 10 = 0"), v, "id", "v", 3).collect())
    few = near()
    monkeypatch.setattr(mapping, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mapping, "CHUNK", 50)
    assert len(few) == 90 and near() == few
    assert mapping.nearest(v.limit(0), v, "id", "v", 3).count() == 0 and mapping.nearest(v, v.limit(0), "id", "v", 3).count() == 0


def test_statements():
    assert load.merge_statement("T", "S", ["k"], ["k", "v"]) == "MERGE INTO T t USING S s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)"
    assert load.merge_statement("T", "S", [], ["v"]) == "INSERT INTO T (v) SELECT v FROM S"
    with pytest.raises(ValueError, match="unsafe"):
        load.copy_statement("T; DROP", "x")
    assert json.loads(load.pipeline(["A"], "s", "t"))["activities"][0]["name"] == "copy_A" and load.replication(["A"], "s", "t") == "MAP s.A, TARGET t.A;"


def test_files_and_load(spark, tmp_path):
    df = spark.createDataFrame([("A", 'x "q", y', 1), ("B", None, 2)], "entity string, v string, n int")
    load.write_csv(df, str(tmp_path / "E.csv"))
    assert files.extract(spark, str(tmp_path), "E", "csv").count() == 2
    assert files.extract(spark, str(tmp_path), "E", "csv", schema=df.schema).where("entity = 'A'").first()["v"] == 'x "q", y'
    (tmp_path / "l.json").write_text('[{"id": "L", "name": "n", "entries": [{"code": "1", "isActive": true}]}]')
    assert files.code_lists(spark, str(tmp_path / "l.json")).first()["code"] == "1"
    (tmp_path / "x.xml").write_text("<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert files.extract(spark, str(tmp_path), "x", "xml").count() == 2
    assert load.entities(df, "entity") == ["A", "B"]
    load.write(df, str(tmp_path / "out"), "entity")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert "| A |" in load.markdown(df, ["entity"]) and files.describe(df, ("n",)).where("is_key").first()["name"] == "n"


def test_paged_source_and_retry(spark):
    calls, waits = [], []

    def get(url, headers):
        calls.append(url)
        if len(calls) < 3:
            m = Message()
            m["Retry-After"] = "7"
            raise urllib.error.HTTPError(url, 429 if len(calls) == 1 else 503, "", m if len(calls) == 1 else None, None)
        return b'{"value": 1}'

    assert paged.fetch("u", {}, get=get, sleep=waits.append) == {"value": 1} and waits[0] == 7 and len(calls) == 3
    r = paged.PagedReader({"url": "u{page}", "pages": "10", "parallel": "4"}, spark.range(1).schema)
    assert [(p.first, p.last) for p in r.partitions()] == [(1, 3), (4, 6), (7, 9), (10, 10)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"2024-01-01 00:{n:02d}:00", n % 3) for n in range(30)], "id long, t string, k int").withColumn("t", F.col("t").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: incremental.stream_files(spark, str(tmp_path / "in"), rows.schema)
    got: list = []
    keep = lambda df, _: got.extend(df.collect())
    from tallywright.rules.engine import ColumnRule

    incremental.run_available(incremental.stream_findings(stream(), [ColumnRule("R", "r", "INFO", lambda: F.col("k") == 1)], "E", "id"), str(tmp_path / "c1"), keep)
    assert len(got) == 10
    incremental.run_available(incremental.stream_findings(stream(), [ColumnRule("R", "r", "INFO", lambda: F.col("k") == 1)], "E", "id"), str(tmp_path / "c1"), keep)
    assert len(got) == 10
    got.clear()
    incremental.run_available(incremental.windowed_counts(stream(), "t", "1 minute", "10 minutes", None, "k"), str(tmp_path / "c2"), keep, "append")
    assert sum(r["n"] for r in got) == 20  # the last window is still open
    got.clear()
    incremental.run_available(incremental.first_seen(stream(), "t", "1 hour", "k"), str(tmp_path / "c3"), keep)
    assert sorted(r["k"] for r in got) == [0, 1, 2]


def test_near_texts_share_a_key(spark):
    rng = random.Random(13)
    pairs = []
    for n in (1, 2, 3, 8, 58, 59, 60, 61, 62, 90):
        for _ in range(12):
            s = "".join(rng.choice("abc") for _ in range(n))
            i = rng.randrange(n)
            pairs += [(s, s), (s, s[:i] + s[i + 1 :]), (s, s[:i] + "x" + s[i:]), (s, s[:i] + "x" + s[i + 1 :]), (s, s[:i] + s[i : i + 2][::-1] + s[i + 2 :])]
    df = spark.createDataFrame([p for p in pairs if p[1]], "a string, b string")
    assert df.where(~F.arrays_overlap(reconcile.near_keys(F.col("a")), reconcile.near_keys(F.col("b")))).count() == 0
    assert df.where(~reconcile.near(F.col("a"), F.col("b"))).count() == 0


def test_fuzzy_query_takes_all_rows(spark):
    from tallywright.functions.values import calendar_date
    from tallywright.queries import reference as Q
    from tallywright.session import table

    sf_dir = "/root/testdata/sf0.001"
    n = lambda c: reconcile.norm(F.col(c))
    d = lambda c: calendar_date(F.col(c)).cast("string")
    a = table(spark, sf_dir, "spriden").select("row_id", n("spriden_last_name"), n("spriden_first_name"), d("spriden_birth_date"), n("email")).collect()
    b = table(spark, sf_dir, "stu").select("row_id", n("stu_surn"), n("stu_fore"), d("stu_dob"), n("email")).collect()

    def edits(x, y):
        t = [[i + j if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
        return t[-1][-1]

    near = lambda x, y: abs(len(x) - len(y)) < 2 and len(set(x) ^ set(y)) < 3 and edits(x, y) < 2
    want = {}
    for i, *x in a:
        for j, *y in b:
            same = [p is not None and p == q for p, q in zip(x, y, strict=True)]
            if not any(same):  # near names alone give 0.37
                continue
            s = sum((w[0] if same[k] else w[1] if x[k] and y[k] and near(x[k], y[k]) else 0) for k, w in ((0, reconcile.LAST), (1, reconcile.FIRST)))
            s = min(1.0, s + same[2] * reconcile.BORN + same[3] * reconcile.EMAIL)
            if s >= 0.7 - 0.15:
                want[i, j] = round(s, 9)
    got = {(r["a_id"], r["b_id"]): round(r["score"], 9) for r in Q.match_fuzzy(spark, sf_dir).collect()}
    assert got == want
