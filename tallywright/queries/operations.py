"""Queries of audits that run, id lookups, validation, migration runs, mapping, sources and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions import text as X
from tallywright.functions import values as V
from tallywright.operators import canonical, codes, findings, mapping, migrate, migration
from tallywright.queries.reference import decisions, id_records, query
from tallywright.rules import engine
from tallywright.session import shared_folder, table
from tallywright.sinks import targets
from tallywright.sources import files
from tallywright.streaming import incremental

# --- audits


def _order_tables(spark: SparkSession, sf_dir: str) -> dict:
    return {"orders": (table(spark, sf_dir, "orders"), "o_orderkey"), "customer": (table(spark, sf_dir, "customer"), "c_custkey")}


_LARGE = engine.ColumnRule("A-1", "large", "WARN", lambda: F.col("o_totalprice") > 400000)
_BROKEN = engine.ColumnRule("A-2", "fails while it runs", "ERROR", lambda: F.when(F.col("o_orderkey") > 10, F.raise_error(F.lit("no such code"))).otherwise(F.lit("")) == "x")
_UNKNOWN = engine.ColumnRule("A-3", "names no column", "ERROR", lambda: F.col("o_nothing") > 1)
_STATUS = engine.CodelistRule("A-4", "status", "CRITICAL", "o_orderstatus", ("O", "F"))


@query("SELECT 'A-1' AS rule_id, count(*) AS n, CAST(0 AS BIGINT) AS broken FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'A-4', count(*), 0 FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT unnest(['A-2', 'A-3']), 1, 1")
def audit_isolated(spark, sf_dir):
    done = engine.audit_now(spark, _order_tables(spark, sf_dir), {"orders": [_LARGE, _BROKEN, _UNKNOWN, _STATUS]})
    return done.findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("message").startswith("rule failed").cast("long")).alias("broken"))


@query("SELECT 'A-1' AS rule_id, count(*) AS n FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'A-4', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def audit_stops_on_critical(spark, sf_dir):
    late = engine.ColumnRule("A-5", "never reached", "INFO", lambda: F.col("o_totalprice") > 0)
    done = engine.audit_now(spark, _order_tables(spark, sf_dir), {"orders": [_LARGE, _STATUS, late]}, stop_on_critical=True)
    return done.findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS subject_id, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def rule_context(spark, sf_dir):
    rule = engine.ContextRule("X", "supplier in debt", "WARN", "l_suppkey", "supplier", lambda s: s.where("s_acctbal > 0").select("s_suppkey"))
    found = engine.run_context(table(spark, sf_dir, "lineitem"), rule, {"supplier": table(spark, sf_dir, "supplier")}, "Line", "l_orderkey")
    return found.select("subject_id", F.col("evidence")["l_suppkey"].alias("value"))


_DECIDED = "SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'ack' WHEN 'view' THEN 'waive' ELSE 'revoke' END AS kind, ts + INTERVAL 10 DAY AS waived_until FROM events"


@query(
    f"""WITH l AS (SELECT * FROM ({_DECIDED}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT count(*) AS total, count(*) FILTER (kind = 'waive' AND waived_until > TIMESTAMP '2024-02-05') AS active_waivers, count(*) FILTER (kind = 'ack') AS active_acks, count(*) FILTER (kind = 'waive' AND NOT waived_until > TIMESTAMP '2024-02-05') AS expired_waivers, count(*) FILTER (kind = 'revoke') AS revoked FROM l"""
)
def waiver_stats(spark, sf_dir):
    last = findings.latest_decision(decisions(spark, sf_dir), "user_id", ["event_id"])
    return findings.waiver_stats(last, F.lit("2024-02-05").cast("timestamp_ntz"))


@query(
    """WITH e AS (SELECT user_id AS k, event_id, CASE WHEN event_type = 'error' THEN 'skipped' ELSE 'resolved' END AS kind FROM events WHERE event_type IN ('error', 'purchase')),
s AS (SELECT c_custkey, coalesce((arg_min(kind, event_id)), 'open') AS state, greatest(count(kind) - 1, 0) AS refused FROM customer LEFT JOIN e ON k = c_custkey GROUP BY c_custkey)
SELECT state, count(*) AS n, CAST(sum(refused) AS BIGINT) AS refused FROM s GROUP BY state"""
)
def queue_stats(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").select(F.col("user_id").alias("c_custkey"), "event_id", F.when(F.col("event_type") == "error", "skipped").otherwise("resolved").alias("kind"))
    states = findings.queue_states(table(spark, sf_dir, "customer").select("c_custkey"), events, "c_custkey", "event_id")
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("refused").alias("refused"))


@query(
    """SELECT o_orderkey AS k, ntile(4) OVER w AS quarter, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 1, -1) OVER w AS after, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS priority_rank,
CAST(sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""
)
def rank_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    last = F.sum(F.round("o_totalprice").cast("bigint")).over(w.rowsBetween(-2, Window.currentRow))
    rank = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).cast("bigint")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 1, -1).over(w).alias("after"), rank.alias("priority_rank"), last.alias("last_three"))


@query("SELECT row_id, sha256('{' || array_to_string(list_transform(list_sort(map_entries(coalesce(evidence, MAP {}))), lambda e: to_json(e.key) || ':' || coalesce(to_json(e.value), 'null')), ',') || '}') AS digest FROM finding")
def stable_digest(spark, sf_dir):
    return table(spark, sf_dir, "finding").select("row_id", F.sha2(X.stable_json(F.col("evidence")), 256).alias("digest"))


_SIDES = "WITH f AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))"


@query(
    f"""{_SIDES} SELECT CASE WHEN f.k % 7 = 0 THEN 'no native row' END AS native_unavailable, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = f.k AND l_quantity > 40) THEN 'no target row' END AS target_unavailable, count(*) AS n FROM f GROUP BY ALL"""
)
def finding_sides(spark, sf_dir):
    found = engine.run_rules(table(spark, sf_dir, "orders"), [_LARGE, _STATUS], "Order", "o_orderkey")
    sides = {"native": (table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0"), "o_orderkey"), "target": (table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber"), "l_orderkey")}
    return findings.reproduction(found, sides).groupBy("native_unavailable", "target_unavailable").agg(F.count(F.lit(1)).alias("n"))


_CASE = "CASE WHEN spriden_change_ind IS NULL THEN 'current' WHEN spriden_change_ind IN ('I', 'N') THEN 'former' ELSE 'other' END"


@query(f"SELECT row_id, {_CASE} AS state, {_CASE} = 'current' AND email IS NOT NULL AS reachable FROM spriden")
def canonical_derive(spark, sf_dir):
    return canonical.derive(table(spark, sf_dir, "spriden"), {"state": _CASE, "reachable": "state = 'current' AND email IS NOT NULL"}).select("row_id", "state", "reachable")


@query("SELECT CAST(row_id AS VARCHAR) AS row_id, severity, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at FROM finding")
def canonical_coerced(spark, sf_dir):
    rows = canonical.coerced(table(spark, sf_dir, "finding").select("row_id", "severity", "detected_at", "evidence"))
    return rows.select("row_id", "severity", F.substring("detected_at", 1, 19).alias("detected_at"))


# --- ids and keys

_RECORDS = "SELECT c_custkey % 1000 AS canonical, 'banner' AS system, c_custkey AS sid, c_custkey AS o FROM customer UNION ALL SELECT s_suppkey % 1000, CASE WHEN s_suppkey % 3 = 0 THEN 'ucas' ELSE 'sits' END, s_suppkey, s_suppkey FROM supplier"
_INDEX = f"SELECT canonical, CAST(arg_max(sid, o) FILTER (system = 'banner') AS VARCHAR) AS banner_id, CAST(arg_max(sid, o) FILTER (system = 'sits') AS VARCHAR) AS sits_id FROM ({_RECORDS}) GROUP BY canonical"


@query(f"WITH x AS ({_INDEX}) SELECT c_custkey, x.canonical AS canonical_id, x.sits_id AS counterpart FROM customer LEFT JOIN x ON x.banner_id = CAST(c_custkey AS VARCHAR)")
def id_from_banner(spark, sf_dir):
    index = codes.id_index(id_records(spark, sf_dir), "canonical", "system", "sid", "o", ("banner", "sits"))
    ids = table(spark, sf_dir, "customer").select("c_custkey")
    return codes.counterpart(codes.canonical_of(ids, "c_custkey", index, "canonical", "banner"), "c_custkey", index, "canonical", "banner", "sits")


@query(f"WITH x AS ({_INDEX}) SELECT s_suppkey, x.canonical AS canonical_id, x.banner_id AS counterpart FROM supplier LEFT JOIN x ON x.sits_id = CAST(s_suppkey AS VARCHAR)")
def id_from_sits(spark, sf_dir):
    index = codes.id_index(id_records(spark, sf_dir), "canonical", "system", "sid", "o", ("banner", "sits"))
    ids = table(spark, sf_dir, "supplier").select("s_suppkey")
    return codes.counterpart(codes.canonical_of(ids, "s_suppkey", index, "canonical", "sits"), "s_suppkey", index, "canonical", "sits", "banner")


@query(f"WITH x AS ({_INDEX}) SELECT system, CAST(sid AS VARCHAR) AS sid FROM ({_RECORDS}) r WHERE (system = 'banner' AND CAST(sid AS VARCHAR) NOT IN (SELECT banner_id FROM x WHERE banner_id IS NOT NULL)) OR (system = 'sits' AND CAST(sid AS VARCHAR) NOT IN (SELECT sits_id FROM x WHERE sits_id IS NOT NULL))")
def id_unindexed(spark, sf_dir):
    records = id_records(spark, sf_dir)
    index = codes.id_index(records, "canonical", "system", "sid", "o", ("banner", "sits"))
    return codes.unindexed(records, index, "system", "sid", ("banner", "sits")).select("system", "sid")


@query(
    """SELECT row_id, array_to_string(list_sort(list_concat(CASE WHEN coalesce(native_keys['tenant'], '') = 'a' THEN [] ELSE ['tenant'] END, CASE WHEN coalesce(native_keys['pidm'] = subject_id, subject_id IS NULL AND native_keys['pidm'] IS NULL AND list_contains(map_keys(native_keys), 'pidm')) THEN [] ELSE ['pidm'] END)), ',') AS mismatches
FROM (SELECT row_id, subject_id, coalesce(native_keys, MAP {}) AS native_keys FROM finding)"""
)
def sourcekeys_verify(spark, sf_dir):
    expected = F.create_map(F.lit("tenant"), F.lit("a"), F.lit("pidm"), F.col("subject_id"))
    return table(spark, sf_dir, "finding").select("row_id", F.array_join(codes.key_mismatches(F.col("native_keys"), expected), ",").alias("mismatches"))


# --- validation and migration

_STUDENT = "id uuid, sourceId text, husid husid?, firstName text, lastName text, dateOfBirth date, email email?, nationality integer?"
_FORM = {
    "id": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "sourceid": "", "husid": "^\\d{13}$", "firstname": "", "lastname": "", "dateofbirth": "^\\d{4}-\\d{2}-\\d{2}$", "email": "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$", "nationality": "^[+-]?\\d+$",
}
_BLANK = "(x IS NULL OR NOT regexp_matches(x, '\\S'))"
_SAID = " UNION ALL ".join(
    f"SELECT row_id, '{f}' AS field, CASE WHEN {_BLANK} THEN {'NULL' if f in ('husid', 'email', 'nationality') else chr(39) + 'missing' + chr(39)} WHEN NOT regexp_matches(x, '{p}') THEN 'malformed' END AS problem FROM (SELECT row_id, {f} AS x FROM student)" for f, p in _FORM.items()
)


@query(f"SELECT row_id, field, problem FROM ({_SAID}) WHERE problem IS NOT NULL")
def canonical_student(spark, sf_dir):
    return canonical.validate(table(spark, sf_dir, "student"), "row_id", canonical.schema(_STUDENT)).select("row_id", F.lower("field").alias("field"), "problem")


def migrated(spark: SparkSession, sf_dir: str, dry_run: bool = False) -> migration.Run:
    """People and their enrolments, in the target's columns, of whom every fourth is there already."""
    people = table(spark, sf_dir, "spriden").select("row_id", F.col("spriden_id").alias("stu_code"), F.col("spriden_last_name").alias("stu_surn"), F.col("spriden_first_name").alias("stu_fnm1"))
    enrolled = table(spark, sf_dir, "sgbstdn").select("row_id", F.col("sgbstdn_pidm").alias("sce_stuc"), F.col("sgbstdn_majr_code_1").alias("sce_crsc"), F.col("sgbstdn_term_code_eff").alias("term"), "sgbstdn_resd_code", "sgbstdn_mode_code", "sgbstdn_stst_code")
    policy = migration.Policy.parse({"fee_status": {"H": "01", "E": "02"}})

    def enrol(df: DataFrame) -> DataFrame:
        out = migration.enrolments(df, policy, ["sce_stuc"], ["term", "row_id"], "sgbstdn_resd_code", "sgbstdn_mode_code", F.col("sgbstdn_stst_code") == "AS")
        return out.withColumns({"sce_ayrc": migrate.term_year(F.col("term")), "sce_seq2": F.col("attempt")})

    return migration.run({"stu": people, "sce": enrolled}, {"sce": enrol}, targets.SITS, {"stu": "row_id", "sce": "row_id"}, {"stu": people.where("row_id % 4 = 0")}, dry_run)


_BARE = "(x IS NULL OR trim(CAST(x AS VARCHAR)) = '')"
_LANDED = f"""SELECT 'stu' AS entity, row_id, row_id % 4 = 0 AS there, len(list_filter([spriden_id, spriden_last_name, spriden_first_name], lambda x: {_BARE})) AS errors FROM spriden
UNION ALL SELECT 'sce', row_id, false, len(list_filter([CAST(sgbstdn_pidm AS VARCHAR), sgbstdn_majr_code_1, nullif(regexp_extract(sgbstdn_term_code_eff, '^(\\d{{4}})', 1), '')], lambda x: {_BARE})) FROM sgbstdn"""


@query(f"SELECT entity, count(*) AS rows, count(*) FILTER (errors = 0 AND NOT there) AS created, count(*) FILTER (errors = 0 AND there) AS updated, count(*) FILTER (errors > 0) AS skipped, CAST(sum(errors) AS BIGINT) AS validation_errors FROM ({_LANDED}) GROUP BY entity")
def mig_run(spark, sf_dir):
    return migrated(spark, sf_dir).landing.totals()


@query(f"SELECT entity, CAST(floor((row_number() OVER (PARTITION BY entity ORDER BY row_id) - 1) / 1000) AS BIGINT) AS batch, CAST(row_id AS VARCHAR) AS row_key FROM ({_LANDED}) WHERE errors = 0")
def mig_batches(spark, sf_dir):
    return migrated(spark, sf_dir).landing.diffs.where("batch is not null").select("entity", "batch", "row_key")


@query(f"WITH b AS (SELECT entity, there, floor((row_number() OVER (PARTITION BY entity ORDER BY row_id) - 1) / 1000) AS batch FROM ({_LANDED}) WHERE errors = 0) SELECT entity, count(*) AS n FROM b WHERE there OR batch <> 0 GROUP BY entity")
def mig_roll_back(spark, sf_dir):
    landing = migrated(spark, sf_dir).landing
    return targets.roll_back(landing.diffs.where("op <> 'skip'"), landing.rollback, 0).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'sce' AS entity, CAST(row_id AS VARCHAR) AS row_key FROM sgbstdn WHERE sgbstdn_stst_code = 'AS' AND (sgbstdn_mode_code IS NULL OR trim(sgbstdn_mode_code) = '')")
def mig_queue(spark, sf_dir):
    return migrated(spark, sf_dir, dry_run=True).queue


@query(
    """SELECT 'worst severity high' AS reason WHERE EXISTS (SELECT 1 FROM finding WHERE severity = 'CRITICAL')
UNION ALL SELECT 'code set ' || n || CASE WHEN n = 'NONE' THEN ' not measured' ELSE ' not covered' END FROM (VALUES ('STYP'), ('NONE')) t(n) WHERE n = 'NONE' OR (SELECT count(DISTINCT k.sourcecode) * 1.0 / count(DISTINCT s.c) FROM (SELECT 'S' || lpad(CAST(row_id % 100 AS VARCHAR), 2, '0') c FROM stu) s LEFT JOIN codeset_map_entry k ON k.sourcecode = s.c) < 0.99"""
)
def mig_preflight(spark, sf_dir):
    found = table(spark, sf_dir, "finding").withColumn("level", F.when(F.col("severity") == "CRITICAL", "high").otherwise("low"))
    seen = table(spark, sf_dir, "stu").select(F.concat(F.lit("S"), F.lpad((F.col("row_id") % 100).cast("string"), 2, "0")).alias("c"))
    covered = codes.coverage(seen, "c", table(spark, sf_dir, "codeset_map_entry")).select(F.lit("STYP").alias("name"), "ratio")
    return migration.preflight(found, "level", 1000, covered, required={"STYP": 0.99, "NONE": 0.5})


# --- mapping, sources

_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 2))"
_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_SHARE = "coalesce(len(list_intersect({0}, {1})) * 1.0 / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)"


@query(
    f"""WITH c AS (SELECT DISTINCT lang AS n FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT lower(p_name) FROM part WHERE p_size < 5 UNION SELECT 'ri'),
i AS (SELECT DISTINCT p_name AS source, p_type AS canonical, p_brand AS entity FROM part WHERE p_name IS NOT NULL),
m AS (SELECT c.n, canonical, entity, {_WORDS.format("c.n")} ta, {_WORDS.format("source")} tb, {_WORDS.format("canonical")} tc, {_PLAIN.format("c.n")} sa, {_PLAIN.format("source")} sb FROM c CROSS JOIN i),
s AS (SELECT n, canonical, entity, round(CASE WHEN sa = '' OR sb = '' THEN 0 WHEN list_contains(tb, sa) THEN 0.95 WHEN contains(sa, sb) OR contains(sb, sa) THEN 0.8 WHEN greatest({_SHARE.format("ta", "tb")}, {_SHARE.format("ta", "tc")}) >= 0.25 THEN greatest({_SHARE.format("ta", "tb")}, {_SHARE.format("ta", "tc")}) ELSE 0 END, 6) score, 1 AS f FROM m),
l AS (SELECT c.n, 'LEARNT' AS canonical, 'Brand#1' AS entity, 0.9 AS score, 0 AS f FROM c WHERE c.n = 'ECONOMY'),
o AS (SELECT n, entity, canonical, max(score) AS score, arg_min(f, (-score, f)) AS f FROM (SELECT * FROM s UNION ALL SELECT * FROM l) WHERE score > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, f, entity, canonical) AS rank, max(score) OVER (PARTITION BY n) AS top FROM o)
SELECT n AS name, canonical, entity, CAST(score AS DOUBLE) AS score, rank FROM r WHERE rank <= 4 AND top >= 0.35"""
)
def suggest_mapping(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).unionByName(p.select(F.col("p_type").alias("name"))).unionByName(p.where("p_size < 5").select(F.lower("p_name").alias("name"))).unionByName(spark.createDataFrame([("ri",)], "name string"))
    index = p.select(F.col("p_name").alias("source"), F.col("p_type").alias("canonical"), F.col("p_brand").alias("entity"), F.lit("x").alias("system"))
    learned = spark.createDataFrame([("ECONOMY", "LEARNT", "Brand#1", 0.9)], "name string, canonical string, entity string, confidence double")
    return mapping.suggest_mapping(names, "name", index, "x", learned=learned)


@query("SELECT p_name AS canonical, p_brand AS entity, 'banner' AS system, p_type AS source FROM part WHERE p_size % 2 = 0 AND p_type <> '' UNION ALL SELECT p_name, p_brand, 'sits', p_name FROM part WHERE p_size % 3 = 0 AND p_name <> ''")
def corpus_index(spark, sf_dir):
    field = F.struct(F.col("p_name").alias("canonical"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("banner"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("sits"))
    return mapping.flat_index(table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.array(field).alias("fields")))


_TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "student", "stu", "spriden", "sgbstdn", "engagement", "finding")
_NEEDED = ("row_id", "LOADED_AT", "email", "deleted_at")


def columns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the tables, as the catalogue of a database has them."""
    rows = files.describe(table(spark, sf_dir, _TABLES[0])).select(F.lit(_TABLES[0]).alias("table_name"), F.col("name").alias("field"))
    for t in _TABLES[1:]:
        rows = rows.unionByName(files.describe(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), F.col("name").alias("field")))
    return rows


_CATALOGUE = f"SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in _TABLES)})"


@query(
    f"""SELECT t.t AS table_name, f.f AS field, CASE WHEN c.column_name IS NOT NULL THEN 'ok' WHEN t.t = 'invoices' THEN 'unknown' ELSE 'missing' END AS verdict
FROM (SELECT unnest([{", ".join(repr(t) for t in (*_TABLES, "invoices"))}]) AS t) t CROSS JOIN (SELECT unnest([{", ".join(repr(f) for f in _NEEDED)}]) AS f) f LEFT JOIN (SELECT DISTINCT table_name, column_name FROM ({_CATALOGUE})) c ON c.table_name = t.t AND lower(c.column_name) = lower(f.f)"""
)
def preflight_fields(spark, sf_dir):
    need = spark.createDataFrame([(t, f) for t in (*_TABLES, "invoices") for f in _NEEDED], "table_name string, field string")
    return migrate.required_fields(need, columns_of(spark, sf_dir))


@query(f"SELECT table_name, column_name AS field FROM ({_CATALOGUE}) WHERE regexp_matches(column_name, '(?i)_udf[0-9]+$') AND upper(column_name) NOT IN (SELECT upper(sourcecodelist) FROM codeset_map_entry WHERE sourcecodelist IS NOT NULL)")
def unregistered_udf(spark, sf_dir):
    return files.unregistered(columns_of(spark, sf_dir), "field", table(spark, sf_dir, "codeset_map_entry"), "sourcecodelist")


@query("SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL AND lower(source) NOT IN (SELECT lower(source) FROM documents WHERE lang = 'cy' AND source IS NOT NULL)")
def missing_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    return files.missing(d.select(F.col("source").alias("name")), d.where("lang = 'cy'").select(F.col("source").alias("name")), "name")


@query("SELECT row_id, round(date_diff('day', try_cast(dateofbirth AS DATE), DATE '2024-01-01') / 365.25, 6) AS age FROM student WHERE regexp_matches(dateofbirth, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(dateofbirth AS DATE) IS NOT NULL")
def age_years(spark, sf_dir):
    s = table(spark, sf_dir, "student").where(F.col("dateofbirth").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return s.select("row_id", F.round(V.age_years(F.col("dateofbirth").try_cast("date"), F.lit("2024-01-01").cast("date")), 6).alias("age")).where("age is not null")


@query("SELECT doc_id, CASE WHEN length(title) <= 20 THEN title ELSE rtrim(regexp_replace(left(title, 19), '\\s+\\S*$', '')) || '…' END AS title FROM documents")
def text_cut_at_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.cut_at_word(F.col("title"), 20).alias("title"))


# --- streams


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.stream_files(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


@query("SELECT CAST(event_id AS VARCHAR) AS subject_id, 'S-1' AS rule_id FROM events WHERE value > 60 UNION ALL SELECT CAST(event_id AS VARCHAR), 'S-2' FROM events WHERE event_type NOT IN ('view', 'click')")
def stream_findings(spark, sf_dir):
    rules = [engine.ColumnRule("S-1", "high", "WARN", lambda: F.col("value") > 60), engine.CodelistRule("S-2", "type", "INFO", "event_type", ("view", "click"))]
    found = incremental.stream_findings(_streamed(spark, sf_dir), rules, "Event", "event_id")
    return incremental.kept(found.select("subject_id", "rule_id"), _folder(spark))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    counts = incremental.windowed_counts(_streamed(spark, sf_dir), "ts", "10 minutes", "1 hour", None, "event_type")
    return incremental.kept(counts, _folder(spark), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
