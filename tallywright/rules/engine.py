"""Rules of four kinds, compiled to one scan per table, and the findings they give."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.session import cut

SEVERITIES = ("CRITICAL", "ERROR", "WARN", "INFO")
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
FINDING = "finding_id string, rule_id string, rule_name string, severity string, entity_type string, subject_id string, message string, evidence map<string,string>"


def safe(name: str) -> Column:
    """A column by a name that is checked: letters, digits and underscores, with at most one table before it."""
    parts = name.split(".")
    if len(parts) > 2 or not all(_NAME.match(p) for p in parts):
        raise ValueError(f"unsafe field name: {name!r}")
    return F.col(parts[-1])


@dataclass(frozen=True)
class ColumnRule:
    """Fails where `fails` is true; null counts as passed. message may name columns as {{column}}."""

    rule_id: str
    name: str
    severity: str
    fails: Callable[[], Column]
    message: str = ""
    evidence: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def test(self) -> Column:
        return F.coalesce(self.fails(), F.lit(False))


@dataclass(frozen=True)
class CodelistRule:
    """Fails where a value isn't among the codes. Nulls fail only with flag_nulls; with no codes every value fails."""

    rule_id: str
    name: str
    severity: str
    column: str
    codes: tuple[str, ...]
    flag_nulls: bool = False
    message: str = ""
    tags: tuple[str, ...] = ()

    @property
    def evidence(self) -> tuple[str, ...]:
        return (self.column,)

    def test(self) -> Column:
        c = safe(self.column)
        return F.when(c.isNull(), F.lit(self.flag_nulls)).otherwise(~c.isin(*self.codes) if self.codes else F.lit(True))


@dataclass(frozen=True)
class SqlRule:
    """A SELECT that gives subject_id and evidence; {table} stands for a table, :name for an argument."""

    rule_id: str
    name: str
    severity: str
    sql: str
    args: Mapping[str, object] = field(default_factory=dict)
    message: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class StatRule:
    """One finding for a column whose share of nulls, number of values or outliers passes a limit."""

    rule_id: str
    name: str
    severity: str
    column: str
    max_null_pct: float | None = None
    min_cardinality: int | None = None
    max_cardinality: int | None = None
    max_z_score: float | None = None
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class ContextRule:
    """Fails where a value isn't in a set built from all rows of a table (missing), or is in it. context gives that set: one column of a table's rows. Nulls pass."""

    rule_id: str
    name: str
    severity: str
    column: str
    table: str
    context: Callable[[DataFrame], DataFrame]
    missing: bool = True
    message: str = ""
    tags: tuple[str, ...] = ()


class Registry:
    """Rules by id; an id is given once."""

    def __init__(self, rules: Iterable = ()):
        self.rules: dict[str, object] = {}
        for r in rules:
            self.add(r)

    def add(self, rule) -> None:
        if rule.rule_id in self.rules:
            raise ValueError(f"duplicate rule id: {rule.rule_id}")
        if rule.severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {rule.severity}")
        self.rules[rule.rule_id] = rule

    def find(self, tag: str | None = None, severity: str | None = None, prefix: str = "") -> list:
        return [r for i, r in self.rules.items() if i.startswith(prefix) and (tag is None or tag in r.tags) and (severity is None or r.severity == severity)]


def template(text: str, columns: Iterable[str] | None = None) -> Column:
    """A message with {{column}} replaced by the column's text, nulls by nothing; where columns are given, others by nothing too."""
    parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}", text)
    known = lambda p: columns is None or p in columns
    return F.concat(*[F.lit(p) if n % 2 == 0 else F.coalesce(safe(p).cast("string"), F.lit("")) if known(p) else F.lit("") for n, p in enumerate(parts)])


def finding_id(*parts: Column) -> Column:
    """A stable id, so that a task that runs again gives the same finding."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def subject(df: DataFrame, key: str | None, ordinal: str | None = None, resource: str = "") -> Column:
    """The subject of a row: the named key, else id, subject_id or pk, whichever is filled first, else resource:ordinal."""
    names = [c for c in (key, "id", "subject_id", "pk") if c and c in df.columns]
    filled = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in names]
    last = [F.concat(F.lit(resource + ":"), F.col(ordinal).cast("string"))] if ordinal else []
    return F.coalesce(*filled, *last) if filled or last else F.lit(None).cast("string")


def run_rules(df: DataFrame, rules: list, entity: str, key: str) -> DataFrame:
    """The findings of row rules over one table, in one scan: each row gives an array of what failed, which is exploded."""
    tests = []
    for r in rules:
        evidence = F.create_map(*[x for c in r.evidence for x in (F.lit(c), safe(c).cast("string"))]) if r.evidence else F.create_map().cast("map<string,string>")
        tests.append(F.when(r.test(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), template(r.message or r.name).alias("message"), evidence.alias("evidence"))))
    failed = F.filter(F.array(*tests), lambda x: x.isNotNull())
    rows = df.select(subject(df, key).alias("subject_id"), F.explode(failed).alias("_f")).select("subject_id", "_f.*")
    return rows.select(finding_id(F.col("rule_id"), F.lit(entity), F.col("subject_id")).alias("finding_id"), "rule_id", "rule_name", "severity", F.lit(entity).alias("entity_type"), "subject_id", "message", "evidence")


#: What has no part in a rule's structure: texts, quoted names, comments. A column NOT IN a subquery, as a whole condition.
_OPAQUE = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)
_NOT_IN = re.compile(r"\b(?:WHERE|AND|OR|NOT)\s+\(*\s*((?:[A-Z_]\w*\.)?[A-Z_]\w*)\s+NOT\s+IN\s*(\()\s*(?=SELECT\b)", re.I)


def not_in_by_joins(sql: str, plain: Callable[[str], bool]) -> str:
    """A SELECT with each `x NOT IN (SELECT ...)` in words that mean the same, unknown included, for which Spark shuffles.

    It plans NOT IN by sending every row of the subquery to the driver and on to all executors. Here it
    is an anti join by the distinct values, and two questions, whether there is a null and whether
    there is any row. plain tells of a subquery's text whether it may be asked several times: it names
    nothing from outside and always gives the same rows. Others stay as they are.
    """
    blank = _OPAQUE.sub(lambda m: "_" * len(m[0]), sql)
    out, done, at = [], 0, 0
    while m := _NOT_IN.search(blank, at):
        depth = end = 0
        for end in range(m.start(2), len(blank)):
            depth += (blank[end] == "(") - (blank[end] == ")")
            if not depth:
                break
        inner = sql[m.end(2) : end]
        if depth or not plain(inner):
            at = m.end(2)  # there may be one inside
            continue
        x, given = sql[m.start(1) : m.end(1)], f"({not_in_by_joins(inner, plain)}\n) AS _given(_v)"
        unknown = f"EXISTS (SELECT 1 FROM {given} WHERE _v IS NULL) OR ({x} IS NULL AND EXISTS (SELECT 1 FROM {given}))"
        found = f"SELECT 1 FROM (SELECT DISTINCT _v FROM {given}) AS _known WHERE _known._v = {x}"
        out += [sql[done : m.start(1)], f"(NOT EXISTS ({found}) AND CASE WHEN {unknown} THEN CAST(NULL AS BOOLEAN) ELSE TRUE END)"]
        done = at = end + 1
    return "".join(out) + sql[done:]


def _rows(spark: SparkSession, rule: SqlRule, used: Mapping[str, DataFrame]) -> DataFrame:
    """What a SQL rule selects."""
    args = dict(rule.args)

    def plain(subquery: str) -> bool:
        if re.search(r"\bLIMIT\b", subquery, re.I):
            return False
        try:
            return spark.sql(subquery, args=args, **used)._jdf.queryExecution().analyzed().deterministic()
        except AnalysisException:
            return False

    if (sql := not_in_by_joins(rule.sql, plain)) != rule.sql:
        try:
            return spark.sql(sql, args=args, **used)
        except AnalysisException:  # where Spark knows no such subquery, as in a HAVING
            pass
    return spark.sql(rule.sql, args=args, **used)


def run_sql(spark: SparkSession, rule: SqlRule, tables: Mapping[str, DataFrame], entity: str = "") -> DataFrame:
    """The findings of a SQL rule; every column but subject_id is evidence. NOT IN gathers no table: not_in_by_joins()."""
    used = {n: t for n, t in tables.items() if "{" + n + "}" in rule.sql}
    rows = _rows(spark, rule, used)
    rest = [c for c in rows.columns if c != "subject_id"]
    evidence = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    own = rows.select(F.col("subject_id").cast("string").alias("subject_id"), evidence.alias("evidence"), template(rule.message or rule.name, rows.columns).alias("message"))
    return _stamped(own, rule, entity)


def dialect(sql: str) -> str:
    """A rule written for another database in this one's words: SYSDATE, with hours or days taken from it, and days between dates."""
    hours = re.sub(r"(?i)\bSYSDATE\s*-\s*\(\s*(\d+)\s*/\s*24\s*\)", r"(current_timestamp() - INTERVAL \1 HOURS)", sql)
    days = re.sub(r"(?i)\bSYSDATE\s*-\s*(\d+)\b", r"(current_timestamp() - INTERVAL \1 DAYS)", hours)
    return re.sub(r"(?i)\bSYSDATE\b", "current_timestamp()", days)


def _stamped(rows: DataFrame, rule, entity: str) -> DataFrame:
    """Findings of one rule from its subjects, messages and evidence."""
    return rows.select(finding_id(F.lit(rule.rule_id), F.lit(entity), F.col("subject_id")).alias("finding_id"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), F.lit(entity).alias("entity_type"), "subject_id", "message", "evidence")


def run_context(df: DataFrame, rule: ContextRule, tables: Mapping[str, DataFrame], entity: str, key: str) -> DataFrame:
    """The findings of a context rule: the set is told apart on the map side and joined, never gathered."""
    given = rule.context(tables[rule.table])
    known = given.select(F.col(given.columns[0]).cast("string").alias("_known")).distinct()
    rows = df.select(subject(df, key).alias("subject_id"), safe(rule.column).cast("string").alias("_v"), template(rule.message or rule.name, df.columns).alias("message")).where("_v is not null")
    failed = rows.join(known, F.col("_v") == F.col("_known"), "left_anti" if rule.missing else "left_semi")
    return _stamped(failed.select("subject_id", "message", F.create_map(F.lit(rule.column), F.col("_v")).alias("evidence")), rule, entity)


def field_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: total, nulls, distinct, low and high as texts, in one aggregate over one scan."""
    stats = [F.struct(F.count(F.lit(1)).alias("total"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct_values"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(c) for c in columns]
    one = df.agg(*stats)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.field", "x.s.*")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n commonest values, most frequent first, ties by value; nulls don't count."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(n)


def run_stat(df: DataFrame, rule: StatRule, entity: str) -> DataFrame:
    """At most one finding: the limits that the column passes."""
    c = safe(rule.column)
    numeric = c.try_cast("double")
    if rule.max_z_score is None:
        s = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("d"), F.lit(None).cast("double").alias("z"))
    else:
        centre = df.agg(F.avg(numeric).alias("_m"), F.stddev_pop(numeric).alias("_s"))
        s = df.crossJoin(F.broadcast(centre)).agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.count_distinct(c).alias("d"), F.max(F.try_divide(F.abs(numeric - F.col("_m")), F.col("_s"))).alias("z"))
    pct = F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("n")), F.lit(0.0))
    limits = [
        (rule.max_null_pct, "null_pct", lambda m: pct > m), (rule.min_cardinality, "too_few", lambda m: F.col("d") < m),
        (rule.max_cardinality, "too_many", lambda m: F.col("d") > m), (rule.max_z_score, "outlier", lambda m: F.col("z") > m),
    ]
    broken = F.filter(F.array(*[F.when(test(m), F.lit(name)) for m, name, test in limits if m is not None] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    return s.withColumn("_b", broken).where(F.size("_b") > 0).select(finding_id(F.lit(rule.rule_id), F.lit(entity)).alias("finding_id"), F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), F.lit(entity).alias("entity_type"), F.lit(rule.column).alias("subject_id"), F.concat_ws(", ", "_b").alias("message"), F.create_map(F.lit("null_pct"), pct.cast("string"), F.lit("distinct"), F.col("d").cast("string")).alias("evidence"))


@dataclass
class Audit:
    findings: DataFrame
    failed: dict[str, str]


def _found(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, str]], entity: str, rules: list) -> DataFrame:
    """The findings of one rule, or of several row rules in one scan."""
    df, key = tables[entity]
    frames = {n: t for n, (t, _) in tables.items()}
    if isinstance(rules[0], SqlRule):
        return run_sql(spark, rules[0], frames, entity)
    if isinstance(rules[0], StatRule):
        return run_stat(df, rules[0], entity)
    if isinstance(rules[0], ContextRule):
        return run_context(df, rules[0], frames, entity, key)
    return run_rules(df, rules, entity, key)


def _is_row_rule(rule) -> bool:
    return not isinstance(rule, SqlRule | StatRule | ContextRule)


def audit(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, str]], rules: Mapping[str, list], fail_fast: bool = False) -> Audit:
    """All rules of all tables: tables by entity with their key, rules by entity ("*" runs on all).

    Row rules of an entity share a scan. A rule that can't be analysed is counted in `failed` and
    the others go on; with fail_fast the first one raises. Nothing runs yet: audit_now() also
    catches what fails at run time.
    """
    out, failed = [], {}
    for entity, (df, _) in tables.items():
        rows = []
        for r in [*rules.get(entity, []), *rules.get("*", [])]:
            try:
                if _is_row_rule(r):
                    df.select(r.test())
                    rows.append(r)
                else:
                    found = _found(spark, tables, entity, [r])
                    found.schema
                    out.append(found)
            except Exception as e:  # noqa: BLE001
                if fail_fast:
                    raise
                failed[r.rule_id] = str(e)[:500]
        if rows:
            out.append(_found(spark, tables, entity, rows))
    return Audit(reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], FINDING), failed)


def failure(spark: SparkSession, rule, entity: str, error: str) -> DataFrame:
    """The finding that a rule itself failed; its subject is the rule."""
    one = spark.createDataFrame([(f"rule:{rule.rule_id}", f"rule failed: {error}")], "subject_id string, message string")
    return _stamped(one.withColumn("evidence", F.create_map().cast("map<string,string>")), rule, entity)


def audit_now(spark: SparkSession, tables: Mapping[str, tuple[DataFrame, str]], rules: Mapping[str, list], stop_on_critical: bool = False) -> Audit:
    """As audit(), but the rules run, and their findings are written to the checkpoint folder.

    A rule that fails, when it is analysed or at run time, gives a finding that says so, is counted in
    `failed`, and the others go on. Row rules share a scan; only where that fails are they run one by
    one, to tell which it was. With stop_on_critical rules run in their order, and none after the first
    with a CRITICAL finding.
    """
    out, failed = [], {}
    for entity in tables:
        own = [*rules.get(entity, []), *rules.get("*", [])]
        rows = [r for r in own if _is_row_rule(r)]
        waiting = [[r] for r in own] if stop_on_critical else [*([rows] if rows else []), *([r] for r in own if not _is_row_rule(r))]
        while waiting:
            group = waiting.pop(0)
            try:
                found = cut(_found(spark, tables, entity, group))
            except Exception as e:  # noqa: BLE001
                if len(group) > 1:
                    waiting = [[r] for r in group] + waiting
                    continue
                failed[group[0].rule_id] = str(e)[:500]
                found = failure(spark, group[0], entity, str(e).split("\n")[0][:200])
            out.append(found)
            if stop_on_critical and not found.where(F.col("severity") == SEVERITIES[0]).isEmpty():
                return Audit(reduce(DataFrame.unionByName, out), failed)
    return Audit(reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], FINDING), failed)


def capped(findings: DataFrame, per_rule: int, total: int | None = None, order: str = "subject_id") -> DataFrame:
    """The first findings of each rule, and of all, in order of the subject; a cap is this operator's purpose."""
    w = Window.partitionBy("rule_id").orderBy(order, "finding_id")
    kept = findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_rule).drop("_n")
    return kept.orderBy("rule_id", order, "finding_id").limit(total) if total is not None else kept
