"""Targets that rows are landed in: required fields, batches, outcomes, rollback."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.functions.values import is_blank
from tallywright.operators.migrate import number_rows
from tallywright.session import cut


@dataclass(frozen=True)
class Target:
    """A system to write to: its required fields by entity, and the most rows of a batch."""

    name: str
    batch_rows: int
    required: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


def _fields(text: str) -> dict[str, tuple[str, ...]]:
    return {name: tuple(of.split()) for name, of in (line.split(":") for line in text.strip().splitlines())}


#: Required fields by entity of the two target systems, and their batch limits.
SITS = Target("sits", 1000, _fields("""
stu: stu_code stu_surn stu_fnm1
sce: sce_stuc sce_crsc sce_ayrc sce_seq2
scj: scj_stuc scj_crsc scj_code
mab: mab_modc mab_mksc mab_seq1
mav: mav_modc mav_ayrc
mod: mod_code mod_name
crs: crs_code crs_name
ass: ass_stuc ass_modc ass_mark
"""))  # fmt: skip
BANNER = Target("banner", 500, _fields("""
spriden: spriden_pidm spriden_id spriden_last_name spriden_first_name
sgbstdn: sgbstdn_pidm sgbstdn_term_code_eff sgbstdn_styp_code
shrtgpa: shrtgpa_pidm shrtgpa_term_code shrtgpa_gpa
shrtckg: shrtckg_pidm shrtckg_term_code shrtckg_grde_code_final
shrtckn: shrtckn_pidm shrtckn_term_code shrtckn_subj_code shrtckn_crse_numb
sfrstcr: sfrstcr_pidm sfrstcr_term_code sfrstcr_crn
ssbsect: ssbsect_term_code ssbsect_crn ssbsect_subj_code ssbsect_crse_numb
sorlcur: sorlcur_pidm sorlcur_term_code sorlcur_lmod_code
sirasgn: sirasgn_term_code sirasgn_crn sirasgn_pidm
smraprp: smraprp_program smraprp_term_code_eff
"""))  # fmt: skip


@dataclass
class Landing:
    """What became of rows that were landed: diffs (entity, row_key, op, reason, errors, batch, payload) and the rollback log (entity, row_key, batch) of created rows."""

    diffs: DataFrame
    rollback: DataFrame

    def totals(self) -> DataFrame:
        """Per entity: rows, created, updated, skipped, validation_errors."""
        count = lambda op: F.count_if(F.col("op") == op)
        return self.diffs.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), count("create").alias("created"), count("update").alias("updated"), count("skip").alias("skipped"), F.sum(F.size("errors")).alias("validation_errors"))


def land(rows: DataFrame, target: Target, entity: str, key: str, existing: DataFrame | None = None, dry_run: bool = False, path: str | None = None) -> Landing:
    """One entity's rows validated, staged in batches and committed.

    A row that lacks a required field is skipped with its errors and never written. The others are
    numbered by key in batches of at most target.batch_rows, over range partitions, not in one task;
    they are updates where existing has their key, else created; a dry run skips them all. With a
    path they are written there, one folder for each entity and batch. Rows of one key are several rows.
    """
    c = {x.lower(): x for x in rows.columns}
    errors = F.array_compact(F.array(*[F.when(is_blank(F.col(c[f]).cast("string")) if f in c else F.lit(True), F.lit(f)) for f in target.required.get(entity, ())] or [F.lit(None).cast("string")]))
    payload = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    checked = cut(rows.select(F.col(key).alias("row_key"), errors.alias("errors"), payload.alias("payload")))
    valid = number_rows(checked.where("size(errors) = 0"), ["row_key"], 0, 1, "_n")
    valid = valid.withColumn("batch", F.floor(F.col("_n").cast("long") / target.batch_rows)).drop("_n")
    if existing is not None:
        valid = valid.join(existing.select(F.col(key).alias("row_key"), F.lit(True).alias("_there")).distinct(), "row_key", "left")
    else:
        valid = valid.withColumn("_there", F.lit(None).cast("boolean"))
    op = F.lit("skip") if dry_run else F.when(F.col("_there"), F.lit("update")).otherwise(F.lit("create"))
    reason = F.lit("dry-run") if dry_run else F.when(F.col("_there"), F.lit("updated")).otherwise(F.lit("created"))
    columns = [F.lit(entity).alias("entity"), "row_key", "op", "reason", "errors", "batch", "payload"]
    done = valid.withColumns({"op": op, "reason": reason}).select(*columns)
    refused = checked.where("size(errors) > 0").withColumns({"op": F.lit("skip"), "reason": F.lit("validation-error"), "batch": F.lit(None).cast("long")}).select(*columns)
    diffs = cut(done.unionByName(refused))
    if path is not None and not dry_run:
        diffs.where("op <> 'skip'").write.mode("append").partitionBy("entity", "batch").parquet(path)
    return Landing(diffs, diffs.where("op = 'create'").select("entity", "row_key", "batch"))


def land_all(frames: Mapping[str, DataFrame], target: Target, keys: Mapping[str, str], existing: Mapping[str, DataFrame] | None = None, dry_run: bool = False, path: str | None = None) -> Landing:
    """Several entities' rows landed, in the order given; row keys come out as texts."""
    done = [land(df, target, entity, keys[entity], (existing or {}).get(entity), dry_run, path) for entity, df in frames.items()]
    text = lambda d: d.withColumn("row_key", F.col("row_key").cast("string"))
    return Landing(reduce(DataFrame.unionByName, [text(x.diffs) for x in done]), reduce(DataFrame.unionByName, [text(x.rollback) for x in done]))


def roll_back(written: DataFrame, log: DataFrame, batch: int | None = None) -> DataFrame:
    """What stays of written rows (entity, row_key) when those of a rollback log, or of one of its batches, are taken out."""
    log = log if batch is None else log.where(F.col("batch") == batch)
    return written.join(log.select("entity", "row_key").distinct(), ["entity", "row_key"], "left_anti")
