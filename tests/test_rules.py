import pytest
from pyspark.sql import functions as F

from tallywright.rules import engine, grammar

ROWS = [(1, "a", 5.0, True), (2, None, None, None), (3, "", -1.0, False), (4, "TRUE", 10.0, True), (5, "5", 5.5, None)]
SCHEMA = "id long, s string, n double, b boolean"
KINDS = {"id": "number", "s": "string", "n": "number", "b": "boolean"}


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    ("ast", "ids"),
    [
        ({"op": "eq", "field": "s", "operands": ["A"]}, [1]), ({"op": "neq", "field": "s", "operands": ["A"]}, [2, 3, 4, 5]), ({"op": "eq", "field": "s", "operands": [None]}, [2]), ({"op": "eq", "field": "s", "operands": [5]}, [5]),
        ({"op": "eq", "field": "b", "operands": ["true"]}, [1, 4]), ({"op": "eq", "field": "s", "operands": [True]}, [4]), ({"op": "in", "field": "n", "operands": [5, None]}, [1, 2]), ({"op": "notIn", "field": "n", "operands": [5, None]}, [3, 4, 5]),
        ({"op": "isNull", "field": "s"}, [2, 3]), ({"op": "isNotNull", "field": "s"}, [1, 4, 5]), ({"op": "lt", "field": "n", "operands": [0]}, [2, 3]), ({"op": "gte", "field": "n", "operands": [5]}, [1, 4, 5]),
        ({"op": "between", "field": "n", "operands": [5, 6]}, [1, 5]), ({"op": "lte", "field": "s", "operands": ["5"]}, [2, 3, 5]), ({"op": "matches", "field": "s", "operands": ["^[a-z]$"]}, [1]), ({"op": "matches", "field": "s", "operands": ["("]}, []),
        ({"op": "matches", "field": "n", "operands": ["5"]}, []), ({"not": {"op": "eq", "field": "n", "operands": [5]}}, [2, 3, 4, 5]), ({"op": "eq", "field": "s", "operands": [{"field": "b"}]}, [2, 4]),
        ({"or": [{"op": "eq", "field": "id", "operands": [1]}, {"and": [{"op": "isNull", "field": "n"}, {"op": "isNull", "field": "b"}]}]}, [1, 2]),
    ],
)
def test_grammar(df, ast, ids):
    assert sorted(r[0] for r in df.where(grammar.compile_rule(ast, KINDS)).select("id").collect()) == ids


@pytest.mark.parametrize("ast", [{"op": "eq", "field": "zz", "operands": [1]}, {"op": "like", "field": "s", "operands": ["x"]}, {"op": "eq", "field": "s", "operands": ["x; DROP TABLE y"]}, {"and": []}, {"op": "eq", "field": "s", "operands": []}, {"op": "in", "field": "n", "operands": list(range(9))}])
def test_grammar_refuses(ast):
    with pytest.raises(grammar.GrammarError):
        grammar.compile_rule(ast, KINDS)


def test_rules_share_a_scan_and_nulls_pass(df):
    rules = [engine.ColumnRule("R1", "low", "ERROR", lambda: F.col("n") < 0, "n is {{n}} of {{s}}", ("n",)), engine.CodelistRule("R2", "code", "WARN", "s", ("a", "TRUE")), engine.CodelistRule("R3", "code", "WARN", "s", ("a",), flag_nulls=True)]
    found = engine.run_rules(df, rules, "E", "id")
    got = sorted((r["rule_id"], r["subject_id"]) for r in found.collect())
    assert got == [("R1", "3"), ("R2", "3"), ("R2", "5"), ("R3", "2"), ("R3", "3"), ("R3", "4"), ("R3", "5")]
    first = [r for r in found.collect() if r["rule_id"] == "R1"][0]
    assert first["message"] == "n is -1.0 of " and first["evidence"] == {"n": "-1.0"}
    assert {r["finding_id"] for r in found.collect()} == {r["finding_id"] for r in engine.run_rules(df.repartition(3), rules, "E", "id").collect()}


def test_audit_goes_on_after_a_broken_rule(spark, df):
    rules = {"t": [engine.ColumnRule("BAD", "bad", "ERROR", lambda: F.col("nope") > 1), engine.SqlRule("SQL", "sql", "INFO", "SELECT id AS subject_id, s FROM {t} WHERE n > :low", {"low": 5.2}), engine.StatRule("ST", "st", "WARN", "s", max_null_pct=10, max_cardinality=3, max_z_score=9)], "*": [engine.ColumnRule("ALL", "all", "INFO", lambda: F.col("id") == 1)]}
    done = engine.audit(spark, {"t": (df, "id")}, rules)
    assert list(done.failed) == ["BAD"]
    assert sorted((r["rule_id"], r["subject_id"]) for r in done.findings.collect()) == [("ALL", "1"), ("SQL", "4"), ("SQL", "5"), ("ST", "s")]
    with pytest.raises(Exception, match="nope"):
        engine.audit(spark, {"t": (df, "id")}, rules, fail_fast=True)
    assert engine.audit(spark, {}, {}).findings.count() == 0


def test_registry_names_and_subjects(spark, df):
    r = engine.Registry([engine.CodelistRule("A", "a", "WARN", "s", (), tags=("x",))])
    with pytest.raises(ValueError, match="duplicate"):
        r.add(engine.CodelistRule("A", "a", "WARN", "s", ()))
    with pytest.raises(ValueError, match="severity"):
        r.add(engine.CodelistRule("B", "a", "LOUD", "s", ()))
    assert [x.rule_id for x in r.find(tag="x", severity="WARN")] == ["A"]
    with pytest.raises(ValueError, match="unsafe"):
        engine.safe("a; b")
    got = spark.createDataFrame([("", "7", 0), (None, None, 1)], "key string, pk string, n int").select(engine.subject(spark.createDataFrame([], "key string, pk string"), "key", "n", "res"))
    assert [x[0] for x in got.collect()] == ["7", "res:1"]


def test_capped(df):
    found = engine.run_rules(df, [engine.ColumnRule("R", "r", "INFO", lambda: F.lit(True)), engine.ColumnRule("S", "s", "INFO", lambda: F.lit(True))], "E", "id")
    assert sorted((r["rule_id"], r["subject_id"]) for r in engine.capped(found, 2).collect()) == [("R", "1"), ("R", "2"), ("S", "1"), ("S", "2")]
    assert engine.capped(found, 2, 3).count() == 3


def test_not_in_of_large_tables_is_not_gathered(spark):
    from tallywright.queries.rule_shapes import RULES

    tables = {"orders": spark.range(1000).toDF("o_orderkey"), "lineitem": spark.range(999).toDF("l_orderkey")}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = engine.run_sql(spark, engine.SqlRule("N", "n", "ERROR", RULES["rule_ref_not_in_null_aware"][0]), tables)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Broadcast" not in plan
        assert sorted((r["subject_id"], r["evidence"]["n"]) for r in found.collect()) == [("1", "1"), ("2", "0")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("given", [[1, 2], [1, None], [None], []])
@pytest.mark.parametrize(
    "where",
    [
        "x NOT IN (SELECT v FROM {g})", "l.x NOT IN (SELECT v FROM {g}) AND x > 1", "x = 3 OR (x NOT IN (SELECT v FROM {g}))", "NOT x NOT IN (SELECT v FROM {g})",
        "s <> ') AND x NOT IN (SELECT' AND x NOT IN (SELECT v FROM {g} WHERE ')' = ')' -- it's the last )\n)", "x NOT IN (SELECT v FROM {g} WHERE v NOT IN (SELECT x FROM {l} WHERE x > 1))", "TRUE AND x + 1 NOT IN (SELECT v FROM {g})", "x NOT IN (SELECT v FROM {g} WHERE v = l.x)",
    ],
)
def test_not_in_by_joins_means_the_same(spark, rows, given, where):
    tables = {"l": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "d")], "x int, s string"), "g": spark.createDataFrame([(v,) for v in given], "v int")}
    sql = f"SELECT x AS subject_id, s FROM {{l}} l WHERE {where}"
    used = {n: t for n, t in tables.items() if "{" + n + "}" in sql}
    assert rows(engine.run_sql(spark, engine.SqlRule("N", "n", "ERROR", sql), tables).select("subject_id", F.col("evidence")["s"])) == [(None if r[0] is None else str(r[0]), r[1]) for r in rows(spark.sql(sql, **used))]


@pytest.mark.parametrize(("given", "unknown"), [([1, 2], [None]), ([1, None], [2, 3, 3, None]), ([], [])])
def test_not_in_by_joins_knows_the_unknown(spark, given, unknown):
    tables = {"l": spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "x int"), "g": spark.createDataFrame([(v,) for v in given], "v int")}
    found = engine.run_sql(spark, engine.SqlRule("N", "n", "ERROR", "SELECT x AS subject_id FROM {l} WHERE (x NOT IN (SELECT v FROM {g})) IS NULL"), tables)
    assert sorted((r["subject_id"] for r in found.collect()), key=str) == sorted((None if x is None else str(x) for x in unknown), key=str)
