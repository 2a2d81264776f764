"""The queries of the general problems over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import values as V
from tallywright.operators.diff import diff_copies
from tallywright.operators.history import history
from tallywright.operators.orphans import Reference, orphan_counts, orphans
from tallywright.operators.profile import FILLER_CODES, FILLER_DATES, column_values, is_missing, profile
from tallywright.operators.snapshots import delta_counts, fingerprint, joined_map, map_text, snapshot_delta
from tallywright.session import table

#: What the fields of canonical records mean; the others are texts.
CANONICAL_KINDS = {
    "dateOfBirth": "date", "startDate": "date", "endDate": "date", "attemptDate": "date",
    "yearOfStudy": "number", "grossFee": "number", "netFee": "number", "credits": "number", "mark": "number",
    "isActive": "boolean", "isCore": "boolean", "resit": "boolean",
}
STUDENT_CODES = ["sgbstdn_stst_code", "sgbstdn_styp_code", "sgbstdn_majr_code_1", "sgbstdn_camp_code", "sgbstdn_resd_code", "sgbstdn_mode_code"]
PERSON_NAMES = ["spriden_id", "spriden_last_name", "spriden_first_name", "spriden_mi"]
#: More than this share of a load's rows is an issue; larger moves than these are a shift.
ISSUE_SHARE, MEDIAN_MOVE, SHARE_MOVE, MEAN_MOVE = 0.15, 6, 0.35, 0.1
AGES = (15, 90)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_copies(table(spark, sf_dir, "canonical_record"), ["entity", "id"], kinds=CANONICAL_KINDS)


def term(c: F.Column) -> F.Column:
    """A term in six digits, or null."""
    s = F.regexp_replace(c, r"(?U)[\s/-]", "")
    return F.when(s.rlike(r"^\d{6}$"), s)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    student = table(spark, sf_dir, "sgbstdn").withColumn("term", term(F.col("sgbstdn_term_code_eff")))
    person = table(spark, sf_dir, "spriden").withColumn("day", F.date_format("spriden_activity_date", "yyyy-MM-dd"))
    code = table(spark, sf_dir, "codeset_map_entry")
    stated = lambda c, otherwise: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(otherwise))
    code = code.withColumns({"code_key": F.concat("map_id", F.lit("|"), "sourcecode"), "starts": stated("activefrom", "0001-01-01"), "ends": stated("activeto", "9999-12-31")})
    parts = [
        ("sgbstdn", "sgbstdn_pidm", history(student, "sgbstdn_pidm", "term", STUDENT_CODES, ["sgbstdn_activity_date", "row_id"], F.lit("999999"))),
        ("spriden", "spriden_pidm", history(person, "spriden_pidm", "day", PERSON_NAMES, [F.col("spriden_change_ind").isNull(), "row_id"], F.lit("9999-12-31"))),
        ("codeset_map_entry", "code_key", history(code, "code_key", "starts", ["targetcode"], ["entry_id"], F.lit("9999-12-31"), end="ends")),
    ]
    out = [h.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("entity_key"), "valid_from", "valid_to") for name, key, h in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def references(spark: SparkSession, sf_dir: str) -> list[Reference]:
    filled = lambda key: F.when(key != "", key)
    pidm = lambda c: F.col(c).cast("string")
    accounts = table(spark, sf_dir, "t1_ar_customer").where(F.upper(F.trim("customertypecode")) == "STU")
    return [
        Reference("sgbstdn", table(spark, sf_dir, "sgbstdn"), pidm("sgbstdn_pidm"), table(spark, sf_dir, "spriden"), pidm("spriden_pidm"), F.col("spriden_change_ind").isNull()),
        Reference("engagement", table(spark, sf_dir, "engagement"), filled(V.uuid_key(F.col("studentid"))), table(spark, sf_dir, "student"), filled(V.uuid_key(F.col("id"))), F.col("deleted_at").isNull()),
        Reference("t1_ar_customer", accounts, filled(V.numbered_key(F.col("customercode"))), table(spark, sf_dir, "stu"), filled(V.numbered_key(F.col("stu_code"))), F.col("deleted_at").isNull()),
    ]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(references(spark, sf_dir)).select("child_table", "row_id", "kind")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(orphans(references(spark, sf_dir)))


def finding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.coalesce(c, F.lit(""))
    key = F.concat_ws("::", part("rule_id"), part("entity_type"), part("subject_id"), joined_map(F.col("native_keys")))
    state = fingerprint(F.col("severity"), F.col("message"), F.col("rule_predicate"), map_text(F.col("evidence")))
    return snapshot_delta(table(spark, sf_dir, "finding"), "tenant_id", "run_id", "run_started_at", "delivery", key, state)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_delta(spark, sf_dir).select("run_id", "delta_key", "kind")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_counts(finding_delta(spark, sf_dir), "run_id")


def load_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    student, score = table(spark, sf_dir, "student"), table(spark, sf_dir, "entity_dhp")
    birth, nation, dhp = F.col("dateofbirth"), F.col("nationality"), F.col("dhp")
    day = F.when(birth.rlike(r"^\d{4}-\d{2}-\d{2}$"), birth.try_cast("date"))
    born, age = F.year(day), F.year("load_date") - F.year(day)
    no_birth = is_missing(birth, FILLER_DATES)
    inside = ~F.isnan(dhp) & dhp.between(0, 1)
    common = ("tenant_id", "load_id", "load_date")
    births = column_values(student, "dateofbirth", *common, birth, no_birth, day.isNotNull(), born, ~no_birth & ~age.between(*AGES))
    nations = column_values(student, "nationality", *common, nation, is_missing(nation, FILLER_CODES), nation.rlike(r"^\d{3}$"), nation.try_cast("double"), F.lit(False))
    scores = column_values(score, "dhp", *common, dhp, dhp.isNull(), inside, dhp, dhp.isNotNull() & ~inside)
    return profile(births.unionByName(nations).unionByName(scores))


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_profile(spark, sf_dir)
    flat = {"double": lambda c: F.round(c, 9), "date": lambda c: F.col(c).cast("string")}
    p = p.withColumn("previous_load", F.col("previous_load").cast("string"))
    return p.select(*[flat.get(kind, F.col)(c).alias(c) for c, kind in p.dtypes])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load_profile(spark, sf_dir)
    col = F.col("column_name")
    text = col.isin("dateofbirth", "nationality")
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), b) > ISSUE_SHARE, F.lit(False))
    shift = (
        F.when(col == "dateofbirth", F.abs(F.col("median") - F.col("median_before")) > MEDIAN_MOVE)
        .when(col == "nationality", F.col("tv") > SHARE_MOVE)
        .otherwise(F.abs(F.col("mean") - F.col("mean_before")) > MEAN_MOVE)
    )
    issues = {
        "missing": text & over("missing", F.col("rows")),
        "pattern": text & over("ill_formed", F.col("rows") - F.col("missing")),
        "range": ((col == "dateofbirth") & over("out_of_range", F.col("well_formed"))) | ((col == "dhp") & (F.col("out_of_range") > 0)),
        "heap": (col == "dateofbirth") & (F.col("heap") > ISSUE_SHARE),
        "shift": F.coalesce(shift, F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in issues.items()]), lambda x: x.isNotNull())
    return p.select("load_id", "column_name", F.explode(found).alias("issue"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p5_found, p5_counts, p6_found, p6_counts, p7_found, p7_profile)}
