import json
import urllib.error
from email.message import Message

import pytest
from pyspark.sql import functions as F

from tallywright import session
from tallywright.functions import text as X
from tallywright.functions import values as V
from tallywright.operators import canonical, codes, findings, mapping, migration
from tallywright.rules import engine
from tallywright.sinks import load, targets
from tallywright.sources import files, paged
from tallywright.streaming import incremental


def test_ids_of_the_index(spark):
    rows = [("c1", "banner", "10", 1), ("c1", "banner", "11", 2), ("c1", "sits", "S1", 3), ("c2", "sits", "S2", 4), ("c3", "ucas", "U", 5)]
    records = spark.createDataFrame(rows, "canonical string, system string, sid string, o int")
    index = codes.id_index(records, "canonical", "system", "sid", "o", ("banner", "sits"))
    ids = spark.createDataFrame([("11",), ("10",), (None,)], "i string")
    got = {r["i"]: r["counterpart"] for r in codes.counterpart(ids, "i", index, "canonical", "banner", "sits").collect()}
    assert got == {"11": "S1", "10": None, None: None}
    assert {r["i"]: r["canonical_id"] for r in codes.canonical_of(ids, "i", index, "canonical", "banner").collect()} == {"11": "c1", "10": None, None: None}
    assert [(r["system"], r["sid"]) for r in codes.unindexed(records, index, "system", "sid", ("banner", "sits")).collect()] == [("banner", "10")]
    assert codes.unindexed(records.limit(0), index, "system", "sid", ("banner", "sits")).count() == 0


def test_keys_and_alternate_ids(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": None}, [("x", "id", "P", False), ("x", "id", "Q", True)]), (2, None, None)], "n int, m map<string,string>, ids array<struct<system:string,type:string,value:string,current:boolean>>")
    expected = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("2"))
    assert [r[0] for r in df.orderBy("n").select(codes.key_mismatches(F.col("m"), expected)).collect()] == [["c"], ["a", "c"]]
    ids = F.col("ids")
    got = df.orderBy("n").select(codes.find_alt_id(ids, "x", "id").alias("v"), codes.has_alt_id(ids, "x", "id", F.lit("p")).alias("p"), codes.has_alt_id(ids, "x", "no", F.lit("p")).alias("q")).collect()
    assert [tuple(r) for r in got] == [("Q", True, False), (None, False, False)]


def test_waivers_and_queue(spark):
    last = spark.createDataFrame([("a", "waive", "2024-02-01"), ("b", "waive", None), ("c", "ack", None), ("d", "revoke", None)], "f string, kind string, waived_until string")
    assert tuple(findings.waiver_stats(last, F.lit("2024-01-01")).first()) == (4, 1, 1, 1, 1)
    assert tuple(findings.waiver_stats(last.limit(0), F.lit("2024-01-01")).first()) == (0, 0, 0, 0, 0)
    events = spark.createDataFrame([("a", 2, "skipped"), ("a", 1, "resolved"), ("z", 1, "skipped")], "k string, n int, kind string")
    got = {tuple(r) for r in findings.queue_states(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), events, "k", "n").collect()}
    assert got == {("a", "resolved", 1), ("b", "open", 0), (None, "open", 0)}


def test_canonical_validation(spark):
    fields = canonical.schema("id uuid, name text, born date?, n number?, k integer?, b boolean?, gone text")
    ok = "0f8fad5b-d9cb-469f-a165-70867728950e"
    df = spark.createDataFrame([(1, ok, "x", "2001-01-02", "1.5", "7", "TRUE"), (2, "zz", " ", "02/01/2001", "x", "7.5", "maybe"), (3, None, None, None, "", None, None)], "row int, ID string, name string, born string, n string, k string, b string")
    got = {(r["row"], r["field"]): r["problem"] for r in canonical.validate(df, "row", fields).collect()}
    bad = {(2, f): "malformed" for f in ("id", "born", "n", "k", "b")}
    assert got == bad | {(2, "name"): "missing", (3, "id"): "missing", (3, "name"): "missing"} | {(r, "gone"): "missing" for r in (1, 2, 3)}
    assert canonical.validate(df.limit(0), "row", fields).count() == 0
    assert all(canonical.schema(s) for s in canonical.SCHEMAS.values())
    with pytest.raises(ValueError, match="unknown kind"):
        canonical.schema("a thing")


def test_landing(spark, tmp_path):
    target = targets.Target("t", 2, {"e": ("a", "missing_column"), "f": ("a",)})
    df = spark.createDataFrame([(n, None if n == 3 else f"v{n}", "clash") for n in range(6)], "k long, A string, op string")
    assert targets.land(df, target, "e", "k").totals().first().asDict() == {"entity": "e", "rows": 6, "created": 0, "updated": 0, "skipped": 6, "validation_errors": 7}
    done = targets.land(df, target, "f", "k", df.where("k = 0"), path=str(tmp_path / "out"))
    got = {r["row_key"]: (r["op"], r["reason"], r["batch"], r["errors"]) for r in done.diffs.collect()}
    assert got == {0: ("update", "updated", 0, []), 1: ("create", "created", 0, []), 2: ("create", "created", 1, []), 3: ("skip", "validation-error", None, ["a"]), 4: ("create", "created", 1, []), 5: ("create", "created", 2, [])}
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 5 and json.loads(written.where("row_key = 1").first()["payload"]) == {"k": 1, "A": "v1", "op": "clash"}
    assert {r["row_key"] for r in targets.roll_back(written, done.rollback, 1).collect()} == {0, 1, 5} and targets.roll_back(written, done.rollback).count() == 1
    dry = targets.land(df, target, "f", "k", dry_run=True, path=str(tmp_path / "none"))
    assert dry.rollback.count() == 0 and {r["reason"] for r in dry.diffs.collect()} == {"dry-run", "validation-error"} and not (tmp_path / "none").exists()
    assert targets.land(df.limit(0), target, "f", "k").diffs.count() == 0
    twice = targets.land(df.where("k = 1").union(df.where("k = 1")), target, "f", "k")
    assert twice.diffs.count() == 2
    both = targets.land_all({"e": df, "f": df}, target, {"e": "k", "f": "k"})
    assert {r["entity"]: r["rows"] for r in both.totals().collect()} == {"e": 6, "f": 6}
    assert len(targets.SITS.required) == 8 and len(targets.BANNER.required) == 10


def test_policies_and_transforms(spark):
    assert migration.Policy.parse({}).fee_default == "99" and migration.Policy.parse({"rounding": "floor"}).number == "sequence"
    for bad in ({"colour": 1}, {"gap": "guess"}, {"gap": "default"}):
        with pytest.raises(ValueError, match="policy|gap"):
            migration.Policy.parse(bad)
    df = spark.createDataFrame([("CS", "1", "4", "202410"), ("AR", "2", "x", None)], "subj string, n string, cr string, term string")
    got = migration.sections(df, migration.Policy.parse({"number_start": 7, "number_width": 3}), "subj", "cr", "term", ["subj", "n"]).orderBy("n").collect()
    assert [(r["number"], r["cats"], r["academic_year"]) for r in got] == [("008", 15, "2024/5"), ("007", None, None)]
    hashed = migration.sections(df, migration.Policy.parse({"number": "hash"}), "subj", "cr", "term", ["n"]).collect()
    assert all(len(r["number"]) >= 5 and r["number"].isdigit() for r in hashed)
    e = spark.createDataFrame([(1, 1, "H", None, True), (1, 2, "Z", "", True), (2, 1, None, "I", False)], "p int, t int, resd string, cls string, fin boolean")
    run = lambda **policy: {(r["p"], r["t"]): (r["attempt"], r["fee_status"], r["gap"], r["cls"]) for r in migration.enrolments(e, migration.Policy.parse({"fee_status": {"H": "01"}} | policy), ["p"], ["t"], "resd", "cls", F.col("fin")).collect()}
    assert run() == {(1, 1): (1, "01", "queued", None), (1, 2): (2, "99", "queued", ""), (2, 1): (1, "99", None, "I")}
    assert run(gap="default", gap_default="P")[(1, 1)] == (1, "01", "filled", "P") and run(gap="skip")[(1, 2)][2] == "skipped"
    g = migration.grades(spark.createDataFrame([("A",), ("?",), (None,)], "g string"), migration.Policy.parse({"grades": {"A": "70"}}), "g")
    assert {r["g"]: (r["numeric_grade"], r["unknown_grade"]) for r in g.collect()} == {"A": ("70", False), "?": (None, True), None: (None, False)}


def test_preflight(spark):
    found = spark.createDataFrame([("low",), ("strange",), (None,)], "s string")
    covered = spark.createDataFrame([("A", 0.99)], "name string, ratio double")
    assert migration.preflight(found, "s", 500, covered, required={"A": 0.9}).count() == 0
    assert migration.preflight(found.limit(0), "s", 500, covered).count() == 0
    reasons = {r[0] for r in migration.preflight(found.union(spark.createDataFrame([("critical",)], "s string")), "s", 5, covered, required={"A": 1.0, "B": 0.1}).collect()}
    assert reasons == {"worst severity critical", "sample of 5 rows", "code set A not covered", "code set B not measured"}


def test_suggestions(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "c string")
    got = {r["c"]: (r["t"], r["score"]) for r in mapping.suggest(one("studentid", "id", "___", "x", None), "c", one("id", "studentId", "zz").withColumnRenamed("c", "t"), "t").where("rank = 1").collect()}
    assert got == {"studentid": ("studentId", 0.95), "id": ("id", 0.95)}
    assert {(r["t"], r["score"]) for r in mapping.suggest(one("studentid"), "c", one("id").withColumnRenamed("c", "t"), "t").collect()} == {("id", 0.8)}
    index = spark.createDataFrame([("firstName", "student", "sits", "STU.stu_fnm1"), ("studentCode", "student", "sits", "STU.STU_CODE"), ("code", "module", "sits", "MOD.mod_code"), ("x", "student", "banner", "q")], "canonical string, entity string, system string, source string")
    learned = spark.createDataFrame([("zzz", "firstName", "student", 0.9)], "c string, canonical string, entity string, confidence double")
    rows = mapping.suggest_mapping(one("CODE", "first name", "zzz", "unknown"), "c", index, "sits", learned=learned).collect()
    best = {r["c"]: (r["entity"], r["canonical"], r["score"]) for r in rows if r["rank"] == 1}
    assert best == {"CODE": ("module", "code", 0.95), "first name": ("student", "firstName", 1.0), "zzz": ("student", "firstName", 0.9)}
    assert {r["canonical"] for r in mapping.suggest_mapping(one("CODE"), "c", index, "sits", ["student"]).collect()} == {"studentCode"}
    lines = {r["c"]: r["line"] for r in mapping.suggestion_lines(mapping.suggest_mapping(one("CODE"), "c", index, "sits"), one("CODE", "unknown"), "c").collect()}
    assert lines["unknown"] == "| unknown | no match |" and lines["CODE"].startswith("| CODE | module.code (0.95), student.")


def test_loaders(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"id": "m", "version": "1", "sourceCodelist": "A", "targetCodelist": "B", "entries": [{"sourceCode": "1", "targetCode": "x"}, {"sourceCode": "2", "targetCode": "y", "activeFrom": "2020-01-01"}]}))
    maps = files.code_maps(spark, str(tmp_path / "m.json"))
    assert [(r["sourcecode"], r["entry_id"]) for r in maps.orderBy("entry_id").collect()] == [("1", 1), ("2", 2)]
    assert codes.translate(spark.createDataFrame([("1",), ("2",)], "c string"), "c", maps, F.lit("2019-01-01")).where("target is null").count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"sections": [{"entity": "student", "fields": [{"canonical": "a", "banner": "B.a", "sits": None}, {"canonical": "b", "banner": "", "sits": "S.b"}]}]}))
    flat = mapping.flat_index(files.corpus(spark, str(tmp_path / "c.json")))
    assert {tuple(r) for r in flat.collect()} == {("a", "student", "banner", "B.a"), ("b", "student", "sits", "S.b")}
    described = spark.createDataFrame([("Contact", [("Type", [("A", None, None), ("B", "Bee", False)]), ("Empty", None)])], "object string, fields array<struct<name:string,values:array<struct<value:string,label:string,active:boolean>>>>")
    assert [tuple(r) for r in files.picklists(described).collect()] == [("Contact.Type", "A", "A", True, 0), ("Contact.Type", "B", "Bee", False, 1)]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r[0] for r in files.missing(names("A", "B", "B"), names("a"), "name").collect()] == ["B"]
    audits = spark.createDataFrame([("1", "t", 1), ("2", "t", 3), ("3", "u", 2)], "audit_id string, tenant_id string, created_at int")
    assert [r["audit_id"] for r in files.stored_audits(audits, "t").collect()] == ["2", "1"]
    assert files.query_text("SELECT a FROM t", "a > 1", 5) == "SELECT * FROM (SELECT a FROM t) q WHERE (a > 1) FETCH FIRST 5 ROWS ONLY" and files.query_text("SELECT 1") == "SELECT * FROM (SELECT 1) q"
    assert load.lake_plan(names("E", "E").withColumnRenamed("name", "e"), "e", "/r").first().asDict() == {"entity": "E", "folder": "/r/E", "mode": "append", "n": 2} and json.loads(load.integration_tasks(["E"], "s", "t"))[0]["key"] == "load_E"


def test_breaker():
    now = [0.0]
    breaker, asked = paged.Breaker(2, 10, lambda: now[0]), []

    def refuse():
        asked.append(1)
        raise urllib.error.HTTPError("u", 429, "slow down", Message(), None)

    assert [breaker.call("r", refuse, lambda: "cube") for _ in range(4)] == ["cube"] * 4 and len(asked) == 2
    now[0] = 11.0
    assert breaker.call("r", lambda: "live", lambda: "cube") == "live" and not breaker.is_open("r") and breaker.call("other", lambda: 1, lambda: 2) == 1
    with pytest.raises(urllib.error.HTTPError):
        breaker.call("r", lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", Message(), None)), lambda: 0)


def test_rules_that_fail(spark):
    df = spark.createDataFrame([(1, "a"), (2, "7")], "id long, s string")
    rules = [engine.ColumnRule("R1", "one", "WARN", lambda: F.col("id") == 1), engine.ColumnRule("R2", "breaks", "ERROR", lambda: F.when(F.col("s") == "a", F.raise_error(F.lit("no"))).otherwise(F.lit("")) == "x"), engine.SqlRule("R3", "bad sql", "ERROR", "SELEC 1"), engine.ColumnRule("R4", "two", "CRITICAL", lambda: F.col("id") == 2)]
    done = engine.audit_now(spark, {"E": (df, "id")}, {"E": rules})
    assert {(r["rule_id"], r["subject_id"]) for r in done.findings.collect()} == {("R1", "1"), ("R2", "rule:R2"), ("R3", "rule:R3"), ("R4", "2")} and set(done.failed) == {"R2", "R3"}
    first = engine.audit_now(spark, {"E": (df, "id")}, {"E": [rules[3], rules[0]]}, stop_on_critical=True)
    assert [r["rule_id"] for r in first.findings.collect()] == ["R4"]
    context = engine.ContextRule("C", "known", "INFO", "s", "E", lambda t: t.where("id = 2").select("s"), missing=False, message="{{id}}")
    assert [r["message"] for r in engine.audit_now(spark, {"E": (df, "id")}, {"*": [context]}).findings.collect()] == ["2"]
    assert engine.audit_now(spark, {"E": (df.limit(0), "id")}, {}).findings.count() == 0


def test_streams_go_on(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    rows(1, 2).write.parquet(source)
    stream = lambda: incremental.stream_files(spark, source, "n long").where("n > 1")
    assert [r[0] for r in incremental.kept(stream(), folder).collect()] == [2]
    rows(3).write.mode("append").parquet(source)
    assert sorted(r[0] for r in incremental.kept(stream(), folder).collect()) == [2, 3]


def test_texts_and_ages(spark):
    df = spark.createDataFrame([("one two three",), ("short",), ("unbreakableword",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(V.cut_at_word(F.col("t"), 10)).collect()] == ["one two…", "short", "unbreakab…", None, ""]
    assert [r[0] for r in spark.sql("select date'2000-01-01' d union all select null").select(V.age_years(F.col("d"), F.lit("2001-01-01").cast("date"))).collect()] == [pytest.approx(366 / 365.25), None]


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Session())


def test_reproduction_and_narrative(spark):
    assert findings.bound_predicate("a = :x AND b = ':x' AND c::int > :n AND d = :gone", {"x": "O'Neil", "n": 2, "gone": None}) == "a = 'O''Neil' AND b = ':x' AND c::int > 2 AND d = NULL"
    with pytest.raises(KeyError, match="y"):
        findings.bound_predicate(":y", {})
    found = spark.createDataFrame([("1", "WARN", "R", "E"), ("2", "WARN", "R", "E"), (None, "INFO", "Q", "E")], "subject_id string, severity string, rule_id string, entity_type string")
    native = spark.createDataFrame([(1, "x"), (1, "a"), (None, "n")], "id long, v string")
    got = {r["subject_id"]: (r["native_row"], r["native_unavailable"], r["target_unavailable"]) for r in findings.reproduction(found, {"native": (native, "id"), "target": (native.limit(0), "id")}).collect()}
    assert got == {"1": ('{"id":1,"v":"a"}', None, "no target row"), "2": (None, "no native row", "no target row"), None: (None, "no subject", "no subject")}
    assert findings.narrative(found) == "3 findings.\nBy severity: WARN 2, INFO 1.\nBy rule_id: R 2, Q 1.\nBy entity_type: E 3." and findings.narrative(found.limit(0)) == "No findings."


def test_json_vectors_and_dialect(spark):
    df = spark.createDataFrame([({"b": "1", "a": None}, [[3.0, 0.0], [9.0, 9.0], [0.0, 3.0]], [1, 0, 1]), (None, [[0.0, 0.0]], [1])], "m map<string,string>, v array<array<double>>, k array<int>")
    got = df.select(X.stable_json(F.col("m")).alias("j"), mapping.mean_pooled(F.col("v"), F.col("k")).alias("p")).collect()
    assert [r["j"] for r in got] == ['{"a":null,"b":"1"}', "{}"] and [[round(x, 6) for x in r["p"]] for r in got] == [[0.707107, 0.707107], [0.0, 0.0]]
    assert canonical.coerced(df.select("k", F.lit(1.5).alias("n"), F.lit(None).alias("z"))).first()[:] == ("[1,0,1]", "1.5", None)
    assert engine.dialect("x > SYSDATE - (4/24) AND y < sysdate - 14 AND z = SYSDATE") == "x > (current_timestamp() - INTERVAL 4 HOURS) AND y < (current_timestamp() - INTERVAL 14 DAYS) AND z = current_timestamp()"
    assert spark.sql("SELECT " + engine.dialect("SYSDATE > SYSDATE - (4/24)")).first()[0]
