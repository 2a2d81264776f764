"""Queries of the audit, findings, code, matching, migration and mapping operators over the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions import text as X
from tallywright.operators import codes, findings, mapping, migrate, reconcile, verify
from tallywright.rules import engine, grammar
from tallywright.sinks import load
from tallywright.sources import files
from tallywright.session import table
from tallywright.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- audits


def order_rules() -> list:
    prioritised = lambda: F.when(F.col("o_orderkey") % 97 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return [
        engine.ColumnRule("ORD-01", "price above limit", "WARN", lambda: F.col("o_totalprice") > 400000, "order {{o_orderkey}} is large", ("o_totalprice",)),
        engine.ColumnRule("ORD-02", "priority missing", "ERROR", lambda: prioritised().isNull()),
        engine.CodelistRule("ORD-03", "status unknown", "CRITICAL", "o_orderstatus", ("O", "F")),
        engine.ColumnRule("ORD-04", "dated too early", "INFO", lambda: F.col("o_orderdate") < F.lit("1992-02-01").cast("timestamp_ntz")),
    ]


_ORDER_FINDINGS = """
SELECT 'ORD-01' AS rule_id, 'WARN' AS severity, o_orderkey AS k FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT 'ORD-02', 'ERROR', o_orderkey FROM orders WHERE o_orderkey % 97 = 0
UNION ALL SELECT 'ORD-03', 'CRITICAL', o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'ORD-04', 'INFO', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1992-02-01'"""


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.run_rules(table(spark, sf_dir, "orders"), order_rules(), "Order", "o_orderkey")


@query(f"SELECT rule_id, severity, CAST(k AS VARCHAR) AS subject_id FROM ({_ORDER_FINDINGS})")
def audit_batch(spark, sf_dir):
    return order_findings(spark, sf_dir).select("rule_id", "severity", "subject_id")


@query(f"SELECT rule_id, severity, count(*) AS n FROM ({_ORDER_FINDINGS}) GROUP BY ALL")
def audit_summary(spark, sf_dir):
    done = engine.audit(spark, {"orders": (table(spark, sf_dir, "orders"), "o_orderkey")}, {"orders": order_rules()})
    return done.findings.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT rule_id, CAST(k AS VARCHAR) AS subject_id FROM ({_ORDER_FINDINGS}) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY CAST(k AS VARCHAR)) <= 5")
def findings_capped(spark, sf_dir):
    return engine.capped(order_findings(spark, sf_dir), 5).select("rule_id", "subject_id")


@query("SELECT o_orderkey AS subject_id FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderpriority IS NULL")
def rule_codelist(spark, sf_dir):
    rule = engine.CodelistRule("C", "c", "ERROR", "o_orderpriority", ("1-URGENT", "2-HIGH"), flag_nulls=True)
    return table(spark, sf_dir, "orders").where(rule.test()).select(F.col("o_orderkey").alias("subject_id"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL")
def rule_codelist_empty(spark, sf_dir):
    rule = engine.CodelistRule("C", "c", "ERROR", "o_orderpriority", ())
    return table(spark, sf_dir, "orders").where(rule.test()).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nationality' AS subject_id WHERE (SELECT 100.0 * count(*) FILTER (nationality IS NULL) / count(*) FROM student) > 1")
def rule_null_rate(spark, sf_dir):
    rule = engine.StatRule("S", "s", "WARN", "nationality", max_null_pct=1)
    return engine.run_stat(table(spark, sf_dir, "student"), rule, "Student").select("subject_id")


@query(
    """WITH d AS (SELECT c_custkey k, '2' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 12, '0') v FROM customer),
s AS (SELECT k, (11 - list_sum(list_transform(list_zip([CAST(substr(v, i, 1) AS INTEGER) FOR i IN range(1, 13)], [9,8,7,6,5,4,3,2,1,0,0,0]), lambda p: p[1] * p[2])) % 11) % 11 g FROM d)
SELECT k AS subject_id, CAST(g AS BIGINT) AS digit FROM s WHERE g <> 10"""
)
def rule_check_digit(spark, sf_dir):
    number = F.concat(F.lit("2"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 12, "0"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), X.check_digit(number).cast("bigint").alias("digit")).where("digit is not null")


@query(
    """SELECT a.event_id AS subject_id, b.event_id AS rate_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def rule_as_of_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.where("event_type in ('purchase', 'view')").withColumns({"is_rate": F.col("event_type") == "view"})
    # both kinds in one order per user: the last rate at or before each row
    w = Window.partitionBy("user_id").orderBy("ts", F.col("is_rate").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rated = rows.withColumn("rate_id", F.last(F.when(F.col("is_rate"), F.col("event_id")), ignorenulls=True).over(w))
    return rated.where(~F.col("is_rate") & F.col("rate_id").isNotNull()).select(F.col("event_id").alias("subject_id"), "rate_id")


_STATS = "SELECT '{c}' AS field, count(*) AS total, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS low, CAST(max({c}) AS VARCHAR) AS high FROM part"


@query(" UNION ALL ".join(_STATS.format(c=c) for c in ("p_brand", "p_type", "p_size")))
def field_stats(spark, sf_dir):
    return engine.field_stats(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT l_shipdate::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def field_top_values(spark, sf_dir):
    return engine.top_values(table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate")), "l_shipdate")


@query("SELECT c_custkey AS subject_id FROM customer WHERE lower(c_mktsegment) = 'building' AND NOT (c_nationkey IN (1, 2, 3))")
def grammar_eq_ci(spark, sf_dir):
    kinds = {"c_mktsegment": "string", "c_nationkey": "number"}
    rule = {"and": [{"op": "eq", "field": "c_mktsegment", "operands": ["Building"]}, {"op": "notIn", "field": "c_nationkey", "operands": [1, 2, "3"]}]}
    return table(spark, sf_dir, "customer").where(grammar.compile_rule(rule, kinds)).select(F.col("c_custkey").alias("subject_id"))


@query("SELECT row_id AS subject_id FROM student WHERE NOT (nationality IS NOT NULL AND lower(nationality) = '826') AND (email IS NULL OR email = '' OR regexp_matches(email, 'test$'))")
def grammar_not_null_logic(spark, sf_dir):
    kinds = {"nationality": "string", "email": "string"}
    rule = {"and": [{"not": {"op": "eq", "field": "nationality", "operands": ["826"]}}, {"or": [{"op": "isNull", "field": "email"}, {"op": "matches", "field": "email", "operands": ["test$"]}]}]}
    return table(spark, sf_dir, "student").where(grammar.compile_rule(rule, kinds)).select(F.col("row_id").alias("subject_id"))


@query("SELECT row_id AS subject_id FROM student WHERE coalesce(dateofbirth, '') >= '2001-01-01' AND coalesce(dateofbirth, '') <= '2001-03-31'")
def grammar_between_string(spark, sf_dir):
    rule = {"op": "between", "field": "dateofbirth", "operands": ["2001-01-01", "2001-03-31"]}
    return table(spark, sf_dir, "student").where(grammar.compile_rule(rule, {"dateofbirth": "string"})).select(F.col("row_id").alias("subject_id"))


# --- findings


@query(
    """WITH p AS (SELECT l_orderkey k, min(l_returnflag) s, CAST(max(l_linenumber) AS VARCHAR) m FROM lineitem WHERE l_orderkey % 10 < 8 GROUP BY 1),
c AS (SELECT l_orderkey k, max(l_returnflag) s, CAST(max(l_linenumber) AS VARCHAR) m FROM lineitem WHERE l_orderkey % 10 > 1 GROUP BY 1),
d AS (SELECT CASE WHEN p.k IS NULL THEN 'new' WHEN c.k IS NULL THEN 'resolved' WHEN p.s <> c.s THEN 'changed' ELSE 'persistent' END kind, CASE WHEN p.s <> c.s THEN 'severity' ELSE '' END reasons FROM p FULL JOIN c ON p.k = c.k)
SELECT kind, reasons, count(*) AS n FROM d GROUP BY ALL"""
)
def findings_delta(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    side = lambda test, agg: l.where(test).groupBy(F.col("l_orderkey").alias("k")).agg(agg("l_returnflag").alias("s"), F.max("l_linenumber").cast("string").alias("m")).select("k", "s", "m", F.lit("x").alias("e"), F.lit("y").alias("p"), F.lit(1).alias("o"))
    delta = findings.finding_delta(side("l_orderkey % 10 < 8", F.min), side("l_orderkey % 10 > 1", F.max), "k", "o", "s", "m", "e", "p")
    return delta.groupBy("kind", "reasons").agg(F.count(F.lit(1)).alias("n"))


_DECISIONS = "SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'ack' WHEN 'view' THEN 'waive' ELSE 'revoke' END AS kind, ts + INTERVAL 10 DAY AS waived_until FROM events"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "ack").when(F.col("event_type") == "view", "waive").otherwise("revoke")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", kind.alias("kind"), (F.col("ts") + F.expr("INTERVAL 10 DAY")).alias("waived_until"))


@query(f"SELECT user_id, arg_max(kind, event_id) AS kind, max(event_id) AS event_id, count(*) AS decisions FROM ({_DECISIONS}) GROUP BY user_id")
def waiver_latest_decision(spark, sf_dir):
    return findings.latest_decision(decisions(spark, sf_dir), "user_id", ["event_id"]).select("user_id", "kind", "event_id", "decisions")


@query(
    f"""SELECT user_id, CASE WHEN kind = 'ack' THEN 'in_review' WHEN kind = 'waive' AND waived_until > TIMESTAMP '2024-02-05' THEN 'waived' ELSE 'open' END AS status
FROM ({_DECISIONS}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
)
def waiver_projection(spark, sf_dir):
    last = findings.latest_decision(decisions(spark, sf_dir), "user_id", ["event_id"])
    return last.select("user_id", findings.waiver_status(F.lit("open"), F.col("kind"), F.col("waived_until"), F.lit("2024-02-05").cast("timestamp_ntz")).alias("status"))


@query(f"SELECT rule_id AS surface, severity, count(*) AS n, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 8 WHEN 'ERROR' THEN 4 WHEN 'WARN' THEN 2 ELSE 1 END) AS BIGINT) AS score FROM ({_ORDER_FINDINGS}) GROUP BY CUBE (rule_id, severity)")
def severity_surface_cube(spark, sf_dir):
    return findings.severity_by_surface(order_findings(spark, sf_dir).withColumnRenamed("rule_id", "surface"), "surface", "severity")


@query(
    """WITH r AS (SELECT source_system AS entity, CASE severity WHEN 'CRITICAL' THEN 'COMPLETENESS' WHEN 'ERROR' THEN 'CONFORMANCE' WHEN 'WARN' THEN 'CONSISTENCY' ELSE 'UNIQUENESS' END AS dimension, sum(CASE WHEN status = 'open' THEN 1 ELSE 0 END) f, count(*) e FROM finding WHERE source_system IS NOT NULL GROUP BY ALL),
d AS (SELECT * FROM (VALUES ('COMPLETENESS', 0.25), ('CONFORMANCE', 0.25), ('CONSISTENCY', 0.2), ('UNIQUENESS', 0.1), ('TIMELINESS', 0.1), ('REFERENTIAL', 0.1)) t(dimension, weight)),
s AS (SELECT x.entity, d.dimension, d.weight, CASE WHEN r.e > 0 THEN round(greatest(0, (r.e - r.f) * 1.0 / r.e), 4) ELSE 1.0 END score FROM (SELECT DISTINCT entity FROM r) x CROSS JOIN d LEFT JOIN r ON r.entity = x.entity AND r.dimension = d.dimension)
SELECT entity, CAST(round(sum(score * weight), 3) AS DOUBLE) AS score FROM s GROUP BY entity"""
)
def scorecard(spark, sf_dir):
    dim = F.when(F.col("severity") == "CRITICAL", "COMPLETENESS").when(F.col("severity") == "ERROR", "CONFORMANCE").when(F.col("severity") == "WARN", "CONSISTENCY").otherwise("UNIQUENESS")
    rows = table(spark, sf_dir, "finding").where("source_system is not null").select(F.col("source_system").alias("entity"), dim.alias("dimension"), F.when(F.col("status") == "open", 1).otherwise(0).alias("f"), F.lit(1).alias("e"))
    scores = findings.scorecard(rows, "entity", "dimension", "f", "e")
    return findings.overall(scores, "entity").select("entity", F.round("score", 3).alias("score"))


@query(
    """WITH s AS (SELECT entity, avg(CASE WHEN isnan(dhp) THEN NULL ELSE dhp END) score FROM entity_dhp GROUP BY entity), b AS (SELECT entity, avg(CASE WHEN isnan(dhp) THEN NULL ELSE dhp END) score FROM entity_dhp WHERE load_date < DATE '2023-06-01' GROUP BY entity)
SELECT s.entity, round(round(s.score, 4) - coalesce(round(b.score, 4), 0), 4) AS change FROM s LEFT JOIN b USING (entity)"""
)
def scorecard_delta(spark, sf_dir):
    score = lambda d: d.groupBy("entity").agg(F.round(F.avg(F.when(~F.isnan("dhp"), F.col("dhp"))), 4).alias("score"))
    d = table(spark, sf_dir, "entity_dhp")
    return findings.score_change(score(d), score(d.where("load_date < '2023-06-01'")), "entity").select("entity", "change")


@query(
    """WITH m AS (SELECT entity, avg(CASE WHEN dhp BETWEEN 0 AND 1 AND NOT isnan(dhp) THEN dhp END) m FROM entity_dhp WHERE entity IN ('student', 'fee', 'module') GROUP BY entity), b AS (SELECT * FROM (VALUES ('student', 0.7), ('fee', 0.9), ('module', 0.99)) t(entity, benchmark))
SELECT entity, CAST(benchmark AS DOUBLE) AS benchmark, CASE WHEN round(m - benchmark, 6) >= 0.02 THEN 'GREEN' WHEN round(m - benchmark, 6) >= -0.05 THEN 'AMBER' ELSE 'RED' END AS rating FROM m JOIN b USING (entity)"""
)
def benchmark_overlay(spark, sf_dir):
    d = table(spark, sf_dir, "entity_dhp").select("entity", F.when(F.col("dhp").between(0, 1) & ~F.isnan("dhp"), F.col("dhp")).alias("score"))
    return findings.overlay(d, "entity", {"student": 0.7, "fee": 0.9, "module": 0.99}).select("entity", "benchmark", "rating")


@query("SELECT rule_id AS value, count(*) AS n FROM finding GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def narrative_counts(spark, sf_dir):
    return findings.narrative_counts(table(spark, sf_dir, "finding"), "rule_id", 5)


# --- codes, effective dating, ids


@query(
    """SELECT row_id, target FROM (SELECT s.row_id, m.targetcode AS target, row_number() OVER (PARTITION BY s.row_id ORDER BY m.tenantid IS NULL, m.entry_id) n
FROM (SELECT row_id, 'S' || lpad(CAST(row_id % 40 AS VARCHAR), 2, '0') c, stu_tent t FROM stu) s LEFT JOIN (SELECT * FROM codeset_map_entry WHERE sourcecodelist = 'STYPE') m ON m.sourcecode = s.c AND (m.tenantid IS NULL OR m.tenantid = s.t) AND (m.activefrom IS NULL OR m.activefrom <= '2019-06-01') AND (m.activeto IS NULL OR '2019-06-01' < m.activeto)) WHERE n = 1"""
)
def code_translate_dated(spark, sf_dir):
    rows = table(spark, sf_dir, "stu").select("row_id", F.concat(F.lit("S"), F.lpad((F.col("row_id") % 40).cast("string"), 2, "0")).alias("c"), F.col("stu_tent").alias("t"))
    maps = table(spark, sf_dir, "codeset_map_entry").where("sourcecodelist = 'STYPE'")
    return codes.translate(rows, "c", maps, F.lit("2019-06-01"), F.col("t")).select("row_id", "target")


@query(
    """WITH s AS (SELECT DISTINCT 'S' || lpad(CAST(row_id % 40 AS VARCHAR), 2, '0') c FROM stu), k AS (SELECT DISTINCT sourcecode c FROM codeset_map_entry)
SELECT count(*) AS observed, count(k.c) AS mapped, coalesce(string_agg(s.c, ',' ORDER BY s.c) FILTER (k.c IS NULL), '') AS unmapped, count(k.c) * 1.0 / count(*) AS ratio FROM s LEFT JOIN k ON s.c = k.c"""
)
def code_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "stu").select(F.concat(F.lit("S"), F.lpad((F.col("row_id") % 40).cast("string"), 2, "0")).alias("c"))
    return codes.coverage(rows, "c", table(spark, sf_dir, "codeset_map_entry"))


@query("SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def eff_activity(spark, sf_dir):
    rows = codes.as_at(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"), "o_orderkey")
    return rows.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))


@query("SELECT sgbstdn_pidm AS k, row_id AS v FROM sgbstdn WHERE sgbstdn_pidm IS NOT NULL AND (sgbstdn_term_code_eff IS NULL OR sgbstdn_term_code_eff <= '202010') QUALIFY row_number() OVER (PARTITION BY sgbstdn_pidm ORDER BY sgbstdn_term_code_eff DESC NULLS LAST, row_id DESC) = 1")
def eff_term(spark, sf_dir):
    rows = codes.as_at(table(spark, sf_dir, "sgbstdn").where("sgbstdn_pidm is not null"), "sgbstdn_pidm", "sgbstdn_term_code_eff", F.lit("202010"), "row_id")
    return rows.select(F.col("sgbstdn_pidm").alias("k"), F.col("row_id").alias("v"))


@query("SELECT map_id || '|' || sourcecode AS k, entry_id AS v FROM codeset_map_entry WHERE activefrom <= '2018-01-01' AND (activeto IS NULL OR '2018-01-01' < activeto) QUALIFY row_number() OVER (PARTITION BY map_id, sourcecode ORDER BY entry_id) = 1")
def eff_from_to(spark, sf_dir):
    rows = table(spark, sf_dir, "codeset_map_entry").withColumn("k", F.concat("map_id", F.lit("|"), "sourcecode"))
    return codes.in_period(rows, "k", "activefrom", "activeto", F.lit("2018-01-01"), "entry_id").select("k", F.col("entry_id").alias("v"))


@query("SELECT spriden_pidm AS k, row_id AS v FROM spriden WHERE coalesce(trim(spriden_change_ind), '') = '' QUALIFY row_number() OVER (PARTITION BY spriden_pidm ORDER BY spriden_activity_date DESC NULLS LAST, row_id) = 1")
def eff_change_ind(spark, sf_dir):
    return codes.by_change_indicator(table(spark, sf_dir, "spriden"), "spriden_pidm", "spriden_change_ind", "spriden_activity_date", "row_id").select(F.col("spriden_pidm").alias("k"), F.col("row_id").alias("v"))


@query("SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def eff_status(spark, sf_dir):
    return codes.by_status(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O", "o_orderkey").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))


@query("SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1")
def eff_snapshot(spark, sf_dir):
    return codes.snapshot(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))


_ALT = "SELECT 'banner' AS system, 'ID' AS type, spriden_id AS value, spriden_activity_date AS first_seen, spriden_change_ind IS NULL AS is_current FROM spriden WHERE spriden_id IS NOT NULL UNION ALL SELECT 'sits', 'HUSID', stu_husid, loaded_at, deleted_at IS NULL FROM stu WHERE stu_husid IS NOT NULL"


@query(f"SELECT system, type, lower(value) AS value, CAST(min(first_seen) AS VARCHAR) AS first_seen, bool_or(is_current) AS is_current FROM ({_ALT}) GROUP BY ALL")
def altid_merge(spark, sf_dir):
    p = table(spark, sf_dir, "spriden").where("spriden_id is not null").select(F.lit("banner").alias("system"), F.lit("ID").alias("type"), F.col("spriden_id").alias("value"), F.col("spriden_activity_date").alias("first_seen"), F.col("spriden_change_ind").isNull().alias("is_current"))
    s = table(spark, sf_dir, "stu").where("stu_husid is not null").select(F.lit("sits").alias("system"), F.lit("HUSID").alias("type"), F.col("stu_husid").alias("value"), F.col("loaded_at").alias("first_seen"), F.col("deleted_at").isNull().alias("is_current"))
    out = codes.merge_alt_ids(p, s)
    return out.withColumn("first_seen", F.rtrim(F.col("first_seen").cast("string")))


@query(
    """WITH m AS (SELECT row_id, map_concat(coalesce(native_keys, MAP {}), MAP {'pidm': 'x', 'run': run_id}) k FROM finding)
SELECT row_id, array_to_string(list_transform(list_sort(map_entries(k)), lambda e: e.key || '=' || e.value), '|') AS keys FROM m"""
)
def sourcekeys_merge(spark, sf_dir):
    right = F.create_map(F.lit("pidm"), F.lit("x"), F.lit("run"), F.col("run_id"))
    return table(spark, sf_dir, "finding").select("row_id", findings.joined_map(codes.merge_source_keys(F.col("native_keys"), right)).alias("keys"))


@query(
    """WITH r AS (SELECT c_custkey % 1000 AS canonical, 'banner' AS system, c_custkey AS sid FROM customer UNION ALL SELECT s_suppkey % 1000, CASE WHEN s_suppkey % 3 = 0 THEN 'ucas' ELSE 'sits' END, s_suppkey FROM supplier)
SELECT canonical, CAST(max(sid) FILTER (system = 'banner') AS VARCHAR) AS banner_id, CAST(max(sid) FILTER (system = 'sits') AS VARCHAR) AS sits_id, coalesce(string_agg(DISTINCT 'ucas:' || sid, ',' ORDER BY 'ucas:' || sid) FILTER (system = 'ucas'), '') AS other_ids FROM r GROUP BY canonical"""
)
def id_index(spark, sf_dir):
    return codes.id_index(id_records(spark, sf_dir), "canonical", "system", "sid", "o", ("banner", "sits"))


def id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("canonical"), F.lit("banner").alias("system"), F.col("c_custkey").cast("string").alias("sid"), F.col("c_custkey").alias("o"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 1000).alias("canonical"), F.when(F.col("s_suppkey") % 3 == 0, "ucas").otherwise("sits").alias("system"), F.col("s_suppkey").cast("string").alias("sid"), F.col("s_suppkey").alias("o"))
    return c.unionByName(s)


# --- verification, preparation, matching

_TWIN = "SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey + CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS c_nationkey FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 23 = 0"


def twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    changed = c.where(k % 11 != 0).select("c_custkey", F.when(k % 13 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 17 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_nationkey") + F.when(k % 19 == 0, 1).otherwise(0)).alias("c_nationkey"))
    return changed.unionByName(c.where(k % 23 == 0).withColumn("c_custkey", k + 10000000))


_VERIFY = f"""WITH b AS ({_TWIN}), j AS (SELECT coalesce(a.c_custkey, b.c_custkey) k, a.c_custkey ak, b.c_custkey bk, a.c_name an, b.c_name bn, a.c_mktsegment am, b.c_mktsegment bm, a.c_nationkey ac, b.c_nationkey bc FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey),
f AS (SELECT k, ak, bk, 'c_name' AS field, an AS x, bn AS y FROM j UNION ALL SELECT k, ak, bk, 'c_mktsegment', am, bm FROM j UNION ALL SELECT k, ak, bk, 'c_nationkey', CAST(ac AS VARCHAR), CAST(bc AS VARCHAR) FROM j),
d AS (SELECT k, CASE WHEN ak IS NULL OR bk IS NULL THEN '<record>' ELSE field END field, CASE WHEN bk IS NULL THEN 'missing-in-b' WHEN ak IS NULL THEN 'missing-in-a' WHEN x IS NOT DISTINCT FROM y THEN 'match' WHEN x IS NULL THEN 'null-in-a' WHEN y IS NULL THEN 'null-in-b' ELSE 'mismatch' END status FROM f WHERE (ak IS NOT NULL AND bk IS NOT NULL) OR field = 'c_name')"""


@query(_VERIFY + " SELECT k AS c_custkey, field, status FROM d")
def verify_fields(spark, sf_dir):
    return verify.verify_fields(table(spark, sf_dir, "customer"), twin(spark, sf_dir), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query(_VERIFY + " SELECT field, count(*) AS comparisons, count(*) FILTER (status = 'match') AS matches, round(count(*) FILTER (status = 'match') / count(*), 6) AS score FROM d WHERE field <> '<record>' GROUP BY ROLLUP (field)")
def verify_scores(spark, sf_dir):
    return verify.verify_scores(verify_fields(spark, sf_dir))


@query(
    f"""WITH s AS ({_TWIN}) SELECT CASE WHEN s.c_custkey % 29 = 0 THEN 'reject' WHEN t.c_custkey IS NULL THEN 'create' WHEN s.c_name IS NOT DISTINCT FROM t.c_name AND s.c_mktsegment IS NOT DISTINCT FROM t.c_mktsegment THEN 'skip' ELSE 'update' END AS verdict, count(*) AS n
FROM s LEFT JOIN customer t ON s.c_custkey = t.c_custkey GROUP BY 1"""
)
def prep_verdicts(spark, sf_dir):
    v = verify.prep_verdicts(twin(spark, sf_dir), table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"], reject=F.col("c_custkey") % 29 == 0, ordinal="c_custkey")
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))



@query(
    """WITH r AS (SELECT 'a' AS side, row_id AS id, nullif(lower(trim(email)), '') AS value FROM spriden UNION ALL SELECT 'b', row_id, nullif(lower(trim(email)), '') FROM stu),
n AS (SELECT *, count(*) FILTER (side = 'a') OVER (PARTITION BY value) AS n_a, count(*) FILTER (side = 'b') OVER (PARTITION BY value) AS n_b FROM r WHERE value IS NOT NULL)
SELECT side, id, value, CASE side WHEN 'a' THEN n_b ELSE n_a END AS links FROM n WHERE n_a > 0 AND n_b > 0"""
)
def match_exact(spark, sf_dir):
    rows = reconcile.exact_classes(table(spark, sf_dir, "spriden"), table(spark, sf_dir, "stu"), ["email"], "row_id", "row_id")
    return rows.select("side", "id", "value", "links")


_ALTERNATE = "SELECT c_custkey AS id, unnest(['crm|n|' || c_custkey % 3000, 'web|w|' || lower(c_name), 'web|w|supplier#' || lpad(CAST(c_custkey % 700 AS VARCHAR), 9, '0')]) AS v FROM customer"


@query(
    f"""SELECT a.id AS a_id, b.id AS b_id FROM ({_ALTERNATE}) a JOIN (SELECT s_suppkey AS id, unnest(['crm|n|' || (s_suppkey * 7), 'web|w|' || lower(s_name)]) AS v FROM supplier) b ON a.v = b.v GROUP BY ALL"""
)
def match_alternate(spark, sf_dir):
    each = lambda system, kind, value: F.struct(F.lit(system).alias("system"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(c.alias("id"), F.array(each("crm", "n", c % 3000), each("web", "w", F.col("c_name")), each("web", "w", F.concat(F.lit("SUPPLIER#"), F.lpad((c % 700).cast("string"), 9, "0")))).alias("alt"))
    b = table(spark, sf_dir, "supplier").select(s.alias("id"), F.array(each("crm", "n", s * 7), each("web", "w", F.col("s_name"))).alias("alt"))
    return reconcile.match_exact(a, b, [], "id", "id", "alt").select("a_id", "b_id")


@query(
    """SELECT a.row_id AS a_id, b.row_id AS b_id, round((1 + CASE WHEN lower(trim(a.spriden_last_name)) = lower(trim(b.stu_surn)) THEN 1 ELSE 0 END + CASE WHEN lower(trim(a.spriden_first_name)) = lower(trim(b.stu_fore)) THEN 1 ELSE 0 END) / 3, 6) AS score
FROM spriden a JOIN stu b ON lower(trim(a.postcode)) = lower(trim(b.postcode)) AND trim(a.postcode) <> ''"""
)
def match_institutional(spark, sf_dir):
    a = table(spark, sf_dir, "spriden").select("row_id", F.col("spriden_last_name").alias("l"), F.col("spriden_first_name").alias("f"), "postcode")
    b = table(spark, sf_dir, "stu").select("row_id", F.col("stu_surn").alias("l"), F.col("stu_fore").alias("f"), "postcode")
    return reconcile.match_institutional(a, b, ["postcode", "l", "f"], "row_id", "row_id", ["postcode"])


_MONTHS = "CASE m WHEN 'JAN' THEN 1 WHEN 'FEB' THEN 2 WHEN 'MAR' THEN 3 WHEN 'APR' THEN 4 WHEN 'MAY' THEN 5 WHEN 'JUN' THEN 6 WHEN 'JUL' THEN 7 WHEN 'AUG' THEN 8 WHEN 'SEP' THEN 9 WHEN 'OCT' THEN 10 WHEN 'NOV' THEN 11 WHEN 'DEC' THEN 12 END"


def _day(c: str) -> str:
    """The date that a text means, in SQL."""
    s = f"upper(regexp_replace({c}, '\\s', '', 'g'))"
    named = "^(\\d{1,2})[- ]?([A-Z]{3})[A-Z]*[- ]?(\\d{4})$"
    month = _MONTHS.replace("CASE m", f"CASE regexp_extract({s}, '{named}', 2)")
    numeric = "^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})$"
    iso = f"regexp_extract({s}, '^(\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}})(T?[0-9:.]*Z?)?$', 1)"
    return f"""CAST(try_cast(CASE WHEN {iso} <> '' THEN replace({iso}, '/', '-')
 WHEN regexp_matches({s}, '{numeric}') THEN regexp_replace({s}, '{numeric}', '\\3-\\2-\\1')
 WHEN regexp_matches({s}, '{named}') THEN regexp_extract({s}, '{named}', 3) || '-' || {month} || '-' || regexp_extract({s}, '{named}', 1)
 WHEN regexp_matches({s}, '^\\d{{8}}$') THEN regexp_replace({s}, '^(\\d{{4}})(\\d{{2}})(\\d{{2}})$', '\\1-\\2-\\3') END AS DATE) AS VARCHAR)"""


def _near(a: str, b: str) -> str:
    """At most one edit: all letters but one, or two exchanged, are in the common beginning and end."""
    head = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"
    tail = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: right({a}, i) = right({b}, i)))"
    swapped = f"(length({a}) = length({b}) AND {head} + {tail} >= length({a}) - 2 AND substr({a}, {head} + 1, 1) = substr({b}, {head} + 2, 1) AND substr({a}, {head} + 2, 1) = substr({b}, {head} + 1, 1))"
    return f"({a} = {b} OR (abs(length({a}) - length({b})) <= 1 AND {head} + {tail} >= greatest(length({a}), length({b})) - 1) OR {swapped})"


_FUZZY = f"""WITH a AS (SELECT row_id AS id, nullif(lower(trim(spriden_last_name)), '') l, nullif(lower(trim(spriden_first_name)), '') f, {_day("spriden_birth_date")} d, nullif(lower(trim(email)), '') e FROM spriden),
b AS (SELECT row_id AS id, nullif(lower(trim(stu_surn)), '') l, nullif(lower(trim(stu_fore)), '') f, {_day("stu_dob")} d, nullif(lower(trim(email)), '') e FROM stu),
met AS (SELECT a.id x, b.id y FROM a JOIN b ON a.l = b.l AND a.f = b.f UNION SELECT a.id, b.id FROM a JOIN b ON a.d = b.d UNION SELECT a.id, b.id FROM a JOIN b ON a.e = b.e),
s AS (SELECT x AS a_id, y AS b_id, least(1.0::DOUBLE, CASE WHEN a.l = b.l THEN 0.35::DOUBLE WHEN {_near("a.l", "b.l")} THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN a.f = b.f THEN 0.2::DOUBLE WHEN {_near("a.f", "b.f")} THEN 0.12::DOUBLE ELSE 0::DOUBLE END
 + CASE WHEN a.d = b.d THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN a.e = b.e THEN 0.15::DOUBLE ELSE 0::DOUBLE END) AS score FROM met JOIN a ON a.id = x JOIN b ON b.id = y),
fuzzy AS (SELECT a_id, b_id, score, CASE WHEN score >= 0.7::DOUBLE + 0.1::DOUBLE THEN 'confident' ELSE 'review' END AS kind FROM s WHERE score >= 0.7::DOUBLE - 0.15::DOUBLE)"""
_GREEDY = """, rounds AS (SELECT a_id, b_id, score, false AS won FROM fuzzy UNION ALL
SELECT a_id, b_id, score, won FROM (SELECT *, bool_or(won) OVER (PARTITION BY a_id) AS wa, bool_or(won) OVER (PARTITION BY b_id) AS wb FROM (
 SELECT a_id, b_id, score, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) = 1 AND row_number() OVER (PARTITION BY b_id ORDER BY score DESC, a_id) = 1 AS won FROM rounds WHERE NOT won))
WHERE won OR NOT (wa OR wb))"""


def fuzzy_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from tallywright.functions.values import calendar_date

    born = lambda c: calendar_date(F.col(c)).cast("string")
    a = table(spark, sf_dir, "spriden").select("row_id", F.col("spriden_last_name").alias("l"), F.col("spriden_first_name").alias("f"), born("spriden_birth_date").alias("d"), "email", "postcode")
    b = table(spark, sf_dir, "stu").select("row_id", F.col("stu_surn").alias("l"), F.col("stu_fore").alias("f"), born("stu_dob").alias("d"), "email", "postcode")
    return a, b


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.match_fuzzy(*fuzzy_sides(spark, sf_dir), "row_id", "row_id", "l", "f", "d", "email")


@query(_FUZZY + " SELECT a_id, b_id, score, kind FROM fuzzy")
def match_fuzzy(spark, sf_dir):
    return fuzzy_pairs(spark, sf_dir)


@query(_FUZZY.replace("WITH a AS", "WITH RECURSIVE a AS", 1) + _GREEDY + " SELECT a_id, b_id, score FROM rounds WHERE won")
def reconcile_one_to_one(spark, sf_dir):
    return reconcile.one_to_one(fuzzy_pairs(spark, sf_dir))


@query(
    _FUZZY.replace("WITH a AS", "WITH RECURSIVE a AS", 1)
    + _GREEDY
    + """, m AS (SELECT a_id, b_id FROM rounds WHERE won), p AS (SELECT x.spriden_last_name l1, y.stu_surn l2, x.email e1, y.email e2, x.postcode p1, y.postcode p2 FROM m JOIN spriden x ON x.row_id = a_id JOIN stu y ON y.row_id = b_id)
SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM spriden WHERE row_id NOT IN (SELECT a_id FROM m)) AS a_only, (SELECT count(*) FROM stu WHERE row_id NOT IN (SELECT b_id FROM m)) AS b_only,
(SELECT count(*) FROM p WHERE coalesce(nullif(lower(trim(l1)), '') <> nullif(lower(trim(l2)), ''), false) OR coalesce(nullif(lower(trim(e1)), '') <> nullif(lower(trim(e2)), ''), false) OR coalesce(nullif(lower(trim(p1)), '') <> nullif(lower(trim(p2)), ''), false)) AS conflicting,
(SELECT count(*) FROM spriden) AS total_a, (SELECT count(*) FROM stu) AS total_b"""
)
def reconcile_report(spark, sf_dir):
    a, b = fuzzy_sides(spark, sf_dir)
    return reconcile.reconciliation_report(reconcile.one_to_one(fuzzy_pairs(spark, sf_dir)), a, b, "row_id", "row_id", {"lastName": ("l", "l"), "email": ("email", "email"), "postcode": ("postcode", "postcode")})


# --- migration


@query("SELECT o_orderkey AS k, CASE WHEN length(CAST(row_number() OVER (ORDER BY o_orderkey) + 999 AS VARCHAR)) < 8 THEN lpad(CAST(row_number() OVER (ORDER BY o_orderkey) + 999 AS VARCHAR), 8, '0') ELSE CAST(row_number() OVER (ORDER BY o_orderkey) + 999 AS VARCHAR) END AS number FROM orders")
def mig_crn_monotonic(spark, sf_dir):
    return migrate.number_rows(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), ["k"], 1000, 8)


@query(
    """WITH t AS (SELECT p_partkey, list_reduce(list_concat([0::BIGINT], list_transform(string_split(concat_ws('|', p_name, p_brand, CAST(p_partkey AS VARCHAR)), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM part)
SELECT p_partkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM t"""
)
def mig_crn_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", migrate.text_hash(F.concat_ws("|", "p_name", "p_brand", F.col("p_partkey").cast("string"))).alias("hash"))


@query("SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS attempt FROM orders")
def mig_attempt(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return migrate.attempts(o, ["o_custkey", "y"], ["o_orderdate", "o_orderkey"]).select(F.col("o_orderkey").alias("k"), "attempt")


@query("SELECT p_partkey AS k, CAST(floor(p_size * 3.75 + 0.5) AS BIGINT) AS cats, CAST(floor(p_size * 3.75) AS BIGINT) AS low, CAST(ceil(p_size * 3.75) AS BIGINT) AS high FROM part")
def mig_cats(spark, sf_dir):
    c = lambda r: migrate.credits_to_cats(F.col("p_size"), r)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), c("nearest").alias("cats"), c("floor").alias("low"), c("ceil").alias("high"))


@query("SELECT row_id, CASE WHEN y <> '' THEN y || '/' || CAST((CAST(y AS INTEGER) + 1) % 10 AS VARCHAR) END AS ayr FROM (SELECT row_id, nullif(regexp_extract(sgbstdn_term_code_eff, '^(\\d{4})', 1), '') y FROM sgbstdn)")
def mig_term_year(spark, sf_dir):
    return table(spark, sf_dir, "sgbstdn").select("row_id", migrate.term_year(F.col("sgbstdn_term_code_eff")).alias("ayr"))


@query("SELECT row_id, CASE sgbstdn_resd_code WHEN 'H' THEN '01' WHEN 'E' THEN '02' ELSE '99' END AS fee FROM sgbstdn")
def mig_grade_fee(spark, sf_dir):
    return migrate.lookup(table(spark, sf_dir, "sgbstdn"), "sgbstdn_resd_code", {"H": "01", "E": "02"}, "fee", "99").select("row_id", "fee")


@query(
    "SELECT row_id, field FROM (SELECT row_id, 'sgbstdn_stst_code' AS field, sgbstdn_stst_code v FROM sgbstdn UNION ALL SELECT row_id, 'sgbstdn_mode_code', sgbstdn_mode_code FROM sgbstdn) WHERE v IS NULL OR trim(v) = ''"
)
def mig_validate(spark, sf_dir):
    return migrate.missing_fields(table(spark, sf_dir, "sgbstdn"), "row_id", ["sgbstdn_stst_code", "sgbstdn_mode_code"])


@query(
    "SELECT coalesce(sgbstdn_camp_code, '') AS entity, CASE WHEN sgbstdn_stst_code IS NULL OR trim(sgbstdn_stst_code) = '' THEN 'skip' WHEN row_id % 3 = 0 THEN 'update' ELSE 'create' END AS op, count(*) AS n FROM sgbstdn GROUP BY ALL"
)
def mig_totals(spark, sf_dir):
    s = table(spark, sf_dir, "sgbstdn")
    staged = migrate.stage(s, "row_id", ["sgbstdn_stst_code"], s.where("row_id % 3 = 0"))
    return migrate.totals(staged, F.coalesce("sgbstdn_camp_code", F.lit("")))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed_orders' ELSE 'open_orders' END AS table_name, CASE WHEN o_orderkey % 2 = 0 THEN 'insert' ELSE 'update' END AS op, count(*) AS n FROM orders GROUP BY ALL")
def load_plan_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "closed_orders").otherwise("open_orders").alias("t"), F.when(F.col("o_orderkey") % 2 == 0, "insert").otherwise("update").alias("op"))
    return load.plan(o, "t", "op")


# --- sources, mapping, text


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def incremental_since(spark, sf_dir):
    return files.since(table(spark, sf_dir, "events"), "ts", "2024-01-20").select("event_id")


@query("SELECT map_id, array_to_string(list(sourcecode ORDER BY activefrom NULLS LAST, sourcecode), ',') AS codes FROM codeset_map_entry GROUP BY map_id")
def grouped_codes(spark, sf_dir):
    return files.grouped_codes(table(spark, sf_dir, "codeset_map_entry"), "map_id", "sourcecode", "activefrom").select("map_id", F.concat_ws(",", "codes").alias("codes"))


@query("SELECT row_id, lower(trim(regexp_replace(stu_surn, '[^A-Za-z0-9]', '', 'g'))) AS squashed FROM stu")
def token_squash(spark, sf_dir):
    return table(spark, sf_dir, "stu").select("row_id", mapping.squashed(F.col("stu_surn")).alias("squashed"))


@query(
    """WITH l AS (SELECT DISTINCT p_name n FROM part), r AS (SELECT DISTINCT p_type n FROM part),
t AS (SELECT l.n a, r.n b, list_distinct(list_filter(string_split(regexp_replace(lower(l.n), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) ta, list_distinct(list_filter(string_split(regexp_replace(lower(r.n), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) tb, regexp_replace(lower(l.n), '[^a-z0-9]', '', 'g') sa, regexp_replace(lower(r.n), '[^a-z0-9]', '', 'g') sb FROM l CROSS JOIN r),
s AS (SELECT a, b, CASE WHEN sa = sb THEN 0.95 WHEN contains(sa, sb) OR contains(sb, sa) THEN 0.8 WHEN len(list_intersect(ta, tb)) * 1.0 / len(list_distinct(list_concat(ta, tb))) >= 0.25 THEN len(list_intersect(ta, tb)) * 1.0 / len(list_distinct(list_concat(ta, tb))) ELSE 0 END score FROM t)
SELECT a AS p_name, b AS p_type, CAST(round(score, 6) AS DOUBLE) AS score, row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS rank FROM s WHERE round(score, 6) >= 0.35 QUALIFY rank <= 4"""
)
def suggest_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return mapping.suggest(p, "p_name", p, "p_type")


@query(
    """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id query_id, e.vec_id id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) s FROM q CROSS JOIN embeddings e)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM s QUALIFY rank <= 5"""
)
def embed_cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return mapping.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5).select("query_id", "id", "rank")


@query(
    """WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), d AS (SELECT DISTINCT w FROM w WHERE w <> ''),
g AS (SELECT w, unnest(list_concat([w], list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)))) AS g FROM d),
h AS (SELECT w, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(g, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 256 AS dim FROM g),
c AS (SELECT p_partkey, dim, count(*) AS n FROM w JOIN h USING (w) GROUP BY ALL)
SELECT p_partkey, count(*) AS dimensions, CAST(sum(dim) AS BIGINT) AS dim_sum, CAST(min(dim) FILTER (n = most) AS BIGINT) AS first_largest, CAST(sum(round(n * 1.0 / least_n * 60)) AS BIGINT) AS weights FROM (SELECT *, max(n) OVER w2 AS most, min(n) OVER w2 AS least_n FROM c WINDOW w2 AS (PARTITION BY p_partkey)) GROUP BY p_partkey"""
)
def embed_names(spark, sf_dir):
    e = mapping.embed(table(spark, sf_dir, "part"), "p_partkey", "p_name").select("p_partkey", F.posexplode("embedding").alias("dim", "v")).where("v > 0")
    m = e.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("dimensions"), F.sum("dim").cast("bigint").alias("dim_sum"), F.max("v").alias("_m"), F.min("v").alias("_l"), F.collect_list(F.struct("dim", "v")).alias("_e"))
    first = F.array_min(F.transform(F.filter("_e", lambda x: x["v"] == F.col("_m")), lambda x: x["dim"]))
    weights = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + F.round(x["v"].cast("double") / F.col("_l").cast("double") * 60))
    return m.select("p_partkey", "dimensions", "dim_sum", first.cast("bigint").alias("first_largest"), weights.cast("bigint").alias("weights"))


@query("SELECT doc_id, md5(" + "regexp_replace(" * len(X.PII) + "text" + "".join(f", '{p}', '[{kind}]', 'g')" for kind, p in X.PII) + ") AS digest FROM documents")
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.redact(F.col("text"))).alias("digest"))


@query(
    """SELECT row_id, coalesce(target, '?') AS target FROM (SELECT s.row_id, m.targetcode AS target, row_number() OVER (PARTITION BY s.row_id ORDER BY m.entry_id) n
FROM (SELECT row_id, 'S' || lpad(CAST(row_id % 60 AS VARCHAR), 2, '0') c FROM stu) s LEFT JOIN codeset_map_entry m ON m.sourcecode = s.c AND m.tenantid IS NULL) WHERE n = 1"""
)
def code_translate(spark, sf_dir):
    rows = table(spark, sf_dir, "stu").select("row_id", F.concat(F.lit("S"), F.lpad((F.col("row_id") % 60).cast("string"), 2, "0")).alias("c"))
    return codes.translate(rows, "c", table(spark, sf_dir, "codeset_map_entry"), default="?").select("row_id", "target")


@query(
    """SELECT c_mktsegment AS entity, c_custkey AS name FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9990)
UNION ALL SELECT 'EXTRA', s_suppkey FROM supplier WHERE s_suppkey < 5"""
)
def dictionary_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    extra = table(spark, sf_dir, "supplier").where("s_suppkey < 5").select(F.lit("EXTRA").alias("entity"), F.col("s_suppkey").alias("name"))
    known = c.where("c_acctbal > 9990").select(F.col("c_mktsegment").alias("entity")).distinct()
    return files.dictionary(c.select(F.col("c_mktsegment").alias("entity"), F.col("c_custkey").alias("name")), known, extra, "entity")


@query("SELECT row_id, CASE WHEN sgbstdn_stst_code = 'AS' AND (sgbstdn_mode_code IS NULL OR trim(sgbstdn_mode_code) = '') THEN 'FT' ELSE sgbstdn_mode_code END AS mode_code, CASE WHEN sgbstdn_stst_code = 'AS' AND (sgbstdn_mode_code IS NULL OR trim(sgbstdn_mode_code) = '') THEN 'filled' END AS gap FROM sgbstdn")
def mig_fill_gap(spark, sf_dir):
    s = table(spark, sf_dir, "sgbstdn").select("row_id", "sgbstdn_stst_code", F.col("sgbstdn_mode_code").alias("mode_code"))
    return migrate.fill_gap(s, "mode_code", F.col("sgbstdn_stst_code") == "AS", "FT").select("row_id", "mode_code", "gap")


@query(
    """WITH n AS (SELECT user_id, event_type AS target, count(*) AS accepts, max(event_id) AS last_accepted FROM events GROUP BY ALL)
SELECT user_id, target, accepts, CAST(least(0.98, round(0.85 + (1 - exp(-0.4 * accepts)) * 0.13, 2)) AS DOUBLE) AS confidence FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY accepts DESC, last_accepted DESC) = 1"""
)
def learned_mapping(spark, sf_dir):
    return mapping.best_learned(table(spark, sf_dir, "events").withColumnRenamed("event_type", "target"), "user_id", "target", "event_id").select("user_id", "target", "accepts", "confidence")


@query(f"SELECT CASE WHEN o.o_orderkey IS NULL THEN 'no native row' END AS unavailable, count(*) AS n FROM ({_ORDER_FINDINGS}) f LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON o.o_orderkey = f.k GROUP BY 1")
def reproduce_findings(spark, sf_dir):
    rows = findings.reproduce(order_findings(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey")
    return rows.groupBy("unavailable").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    rows = incremental.windowed_counts(table(spark, sf_dir, "events"), "ts", "10 minutes", "1 hour", None, "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) k FROM g)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, k"""
)
def window_session(spark, sf_dir):
    rows = incremental.sessions(table(spark, sf_dir, "events"), "ts", "10 minutes", "6 hours", "user_id")
    return rows.select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query(
    f"""WITH d AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) p, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'why' END reason FROM ({_DECISIONS}))
SELECT CASE WHEN kind = 'waive' AND trim(reason) = '' THEN 'no reason' WHEN kind = 'revoke' AND (p IS NULL OR p = 'revoke') THEN 'nothing to revoke' END AS refused, count(*) AS n FROM d GROUP BY 1"""
)
def waiver_validation(spark, sf_dir):
    d = decisions(spark, sf_dir).withColumns({"reason": F.when(F.col("event_id") % 5 == 0, " ").otherwise("why"), "decided_at": F.col("ts")})
    return findings.valid_decisions(d, "user_id", "event_id").groupBy("refused").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT row_id, spriden_change_ind IS NULL OR trim(spriden_change_ind) = '' AS by_indicator, coalesce(spriden_activity_date <= TIMESTAMP '2021-01-01', false) AS by_activity, true AS by_snapshot FROM spriden"""
)
def currentness(spark, sf_dir):
    at = F.lit("2021-01-01").cast("timestamp_ntz")
    status = lambda kind, **signals: codes.current_status(kind, signals, at).alias(f"by_{kind}")
    return table(spark, sf_dir, "spriden").select("row_id", status("indicator", indicator=F.col("spriden_change_ind")), status("activity", date=F.col("spriden_activity_date")), status("snapshot"))


@query(
    """SELECT row_id, coalesce(sgbstdn_term_code_eff <= '202010', false) AS by_term, coalesce(sgbstdn_stst_code IN ('AS', 'R'), false) AS by_status FROM sgbstdn"""
)
def currentness_terms(spark, sf_dir):
    s = table(spark, sf_dir, "sgbstdn")
    return s.select("row_id", codes.current_status("term", {"date": F.col("sgbstdn_term_code_eff")}, F.lit("202010")).alias("by_term"), codes.current_status("status", {"status": F.col("sgbstdn_stst_code"), "active": ("AS", "R")}, F.lit(None)).alias("by_status"))


@query("SELECT entry_id, coalesce(activefrom <= '2018-01-01', false) AND (activeto IS NULL OR '2018-01-01' < activeto) AS by_period FROM codeset_map_entry")
def currentness_periods(spark, sf_dir):
    signals = {"start": F.col("activefrom"), "end": F.col("activeto")}
    return table(spark, sf_dir, "codeset_map_entry").select("entry_id", codes.current_status("period", signals, F.lit("2018-01-01")).alias("by_period"))
