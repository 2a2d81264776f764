"""A migration run: rows of several entities transformed by a policy and landed in a target, and what decides whether it may start."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.values import is_blank
from tallywright.operators import migrate
from tallywright.sinks.targets import Landing, Target, land_all

#: Severities of pre-flight findings in order.
PREFLIGHT_SEVERITIES = ("info", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class Policy:
    """How rows are transformed. parse() reads one from a mapping, each slot that is left out by its default."""

    number: str = "sequence"  # or hash
    number_start: int = 1
    number_width: int = 5
    number_buckets: int = 100_000
    rounding: str = "nearest"  # or floor, ceil
    year_style: str = "YYYY/Y"  # or YYYY-YYYY, YYYY
    attempt_start: int = 1
    fee_status: Mapping[str, str] = field(default_factory=dict)
    fee_default: str = "99"
    grades: Mapping[str, str] = field(default_factory=dict)
    gap: str = "queue"  # or skip, default
    gap_default: str | None = None

    CHOICES = {"number": ("sequence", "hash"), "rounding": ("nearest", "floor", "ceil"), "year_style": ("YYYY/Y", "YYYY-YYYY", "YYYY"), "gap": ("queue", "skip", "default")}  # noqa: RUF012

    @classmethod
    def parse(cls, given: Mapping[str, object]) -> Policy:
        known = {f.name for f in fields(cls)}
        for name, value in given.items():
            if name not in known:
                raise ValueError(f"unknown slot of a policy: {name}")
            if name in cls.CHOICES and value not in cls.CHOICES[name]:
                raise ValueError(f"{name} is {value!r}, not one of {', '.join(cls.CHOICES[name])}")
        policy = replace(cls(), **given)
        if policy.gap == "default" and policy.gap_default is None:
            raise ValueError("gap is default, but gap_default is missing")
        return policy


def sections(df: DataFrame, policy: Policy, subject: str, credits: str, term: str, order: list[str]) -> DataFrame:
    """df with number, cats and academic_year. Numbers are in order of the rows, or hashes of the subject and the order's columns."""
    if policy.number == "sequence":
        out = migrate.number_rows(df, order, policy.number_start, policy.number_width)
    else:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (subject, *order)])
        out = df.withColumn("number", migrate.pad(migrate.hashed_number(text, policy.number_buckets).cast("string"), policy.number_width))
    return out.withColumns({"cats": migrate.credits_to_cats(F.col(credits).try_cast("double"), policy.rounding), "academic_year": migrate.term_year(F.col(term), policy.year_style)})


def enrolments(df: DataFrame, policy: Policy, keys: list[str], order: list[str], residency: str, classification: str, finalist: Column) -> DataFrame:
    """df with attempt, fee_status and gap; a classification that is due and blank is filled, queued or skipped as the policy says."""
    out = migrate.attempts(df, keys, order, policy.attempt_start)
    out = migrate.lookup(out, residency, dict(policy.fee_status), "fee_status", policy.fee_default)
    if policy.gap == "skip":
        gap = F.coalesce(finalist, F.lit(False)) & is_blank(F.col(classification).cast("string"))
        return out.withColumn("gap", F.when(gap, F.lit("skipped")))
    return migrate.fill_gap(out, classification, finalist, policy.gap_default if policy.gap == "default" else None)


def grades(df: DataFrame, policy: Policy, grade: str) -> DataFrame:
    """df with numeric_grade, null where the policy doesn't know the grade, and unknown_grade."""
    out = migrate.lookup(df, grade, dict(policy.grades), "numeric_grade")
    return out.withColumn("unknown_grade", F.col(grade).isNotNull() & F.col("numeric_grade").isNull())


@dataclass
class Run:
    landing: Landing
    queue: DataFrame | None


def run(frames: Mapping[str, DataFrame], transforms: Mapping[str, Callable[[DataFrame], DataFrame]], target: Target, keys: Mapping[str, str], existing: Mapping[str, DataFrame] | None = None, dry_run: bool = True, path: str | None = None) -> Run:
    """All entities transformed (those without a transform pass as they are), validated and landed.

    One diff per row with op and reason, errors and batch; the rollback log of what was created; queue,
    the rows (entity, row_key) that a person has to settle, those whose gap is queued. Nothing is
    written unless dry_run is off and a path is given.
    """
    done = {e: transforms[e](df) if e in transforms else df for e, df in frames.items()}
    landing = land_all(done, target, keys, existing, dry_run, path)
    queued = [df.where(F.col("gap") == "queued").select(F.lit(e).alias("entity"), F.col(keys[e]).cast("string").alias("row_key")) for e, df in done.items() if "gap" in df.columns]
    queue = queued[0] if queued else None
    for q in queued[1:]:
        queue = queue.unionByName(q)
    return Run(landing, queue)


def preflight(findings: DataFrame, severity: str, sample_rows: int, coverage: DataFrame, deny_from: str = "high", sample_floor: int = 100, required: Mapping[str, float] | None = None) -> DataFrame:
    """Rows (reason): why a migration may not start; none where it may.

    The worst severity of the findings must be below deny_from, the sample at least sample_floor rows,
    and each required code set (name, coverage needed) be measured in coverage (name, ratio) and reach it.
    Unknown severities count as none. What comes to one row is aggregated first.
    """
    spark = findings.sparkSession
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in PREFLIGHT_SEVERITIES]), F.lower(severity)), F.lit(0))
    worst = findings.agg(F.max(rank).alias("w"))
    denied = worst.where(F.col("w") >= PREFLIGHT_SEVERITIES.index(deny_from) + 1)
    reasons = denied.select(F.concat(F.lit("worst severity "), F.element_at(F.array(*[F.lit(s) for s in PREFLIGHT_SEVERITIES]), F.col("w").cast("int"))).alias("reason"))
    if sample_rows < sample_floor:
        reasons = reasons.unionByName(spark.createDataFrame([(f"sample of {sample_rows} rows",)], "reason string"))
    if required:
        needed = spark.createDataFrame(list(required.items()), "name string, needed double").join(coverage.select("name", "ratio"), "name", "left")
        short = needed.where(F.col("ratio").isNull() | (F.col("ratio") < F.col("needed")))
        reasons = reasons.unionByName(short.select(F.concat(F.lit("code set "), F.col("name"), F.when(F.col("ratio").isNull(), F.lit(" not measured")).otherwise(F.lit(" not covered"))).alias("reason")))
    return reasons
