"""Findings: deltas with reasons, waivers, pivots, scorecards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.snapshots import joined_map, map_text

#: Weights of severities and quality dimensions.
SEVERITY_WEIGHT = {"CRITICAL": 8, "ERROR": 4, "WARN": 2, "INFO": 1}
DIMENSIONS = {"COMPLETENESS": 0.25, "CONFORMANCE": 0.25, "CONSISTENCY": 0.2, "UNIQUENESS": 0.1, "TIMELINESS": 0.1, "REFERENTIAL": 0.1}


def issue_key(rule: str = "rule_id", entity: str = "entity_type", subject: str = "subject_id", native_keys: str | None = None) -> Column:
    """rule::entity::subject::k=v|k=v, the native keys sorted."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("::", part(rule), part(entity), part(subject), joined_map(F.col(native_keys)) if native_keys else F.lit(""))


def finding_delta(previous: DataFrame, current: DataFrame, key: str, order: str, severity: str, message: str, evidence: str, predicate: str) -> DataFrame:
    """Every issue of two runs as new, resolved, changed or persistent, with the reasons of a change in order.

    Of rows with one key the one last in order counts. Both sides are reduced first and joined by key;
    null keys meet each other.
    """
    kept = [severity, message, evidence, predicate]
    text = lambda d, c: map_text(F.col(c)) if dict(d.dtypes)[c].startswith("map") else F.col(c).cast("string")

    def last(d: DataFrame, side: str) -> DataFrame:
        rows = d.select(F.col(key).alias(f"k_{side}"), F.col(order).alias("_o"), *[text(d, c).alias(f"{n}_{side}") for n, c in enumerate(kept)])
        return rows.groupBy(f"k_{side}").agg(*[F.max_by(f"{n}_{side}", "_o").alias(f"{n}_{side}") for n in range(4)], F.lit(True).alias(f"in_{side}"))

    p, c = last(previous, "p"), last(current, "c")
    both = p.join(c, F.col("k_p").eqNullSafe(F.col("k_c")), "full_outer")
    names = ("severity", "message", "evidence", "rule_predicate")
    reasons = F.concat_ws(",", F.filter(F.array(*[F.when(~F.col(f"{n}_p").eqNullSafe(F.col(f"{n}_c")), F.lit(name)) for n, name in enumerate(names)]), lambda x: x.isNotNull()))
    reasons = F.when(F.col("in_p") & F.col("in_c"), reasons).otherwise(F.lit(""))
    kind = F.when(F.col("in_p").isNull(), F.lit("new")).when(F.col("in_c").isNull(), F.lit("resolved")).when(reasons != "", F.lit("changed")).otherwise(F.lit("persistent"))
    return both.select(F.coalesce("k_c", "k_p").alias("issue_key"), kind.alias("kind"), reasons.alias("reasons"))


def delta_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def latest_decision(decisions: DataFrame, finding: str, order: list[str]) -> DataFrame:
    """The last decision on each finding, and how many there were."""
    return decisions.groupBy(finding).agg(F.max_by(F.struct(*[c for c in decisions.columns if c != finding]), F.struct(*order)).alias("_d"), F.count(F.lit(1)).alias("decisions")).select(finding, "_d.*", "decisions")


def waiver_status(status: Column, kind: Column, until: Column, at: Column) -> Column:
    """A finding's status at a time: ack is in review, waive holds until its end and is open after, revoke opens again, none leaves it."""
    return F.when(kind == "ack", F.lit("in_review")).when((kind == "waive") & (until > at), F.lit("waived")).when(kind.isin("waive", "revoke"), F.lit("open")).otherwise(status)


def waiver_stats(latest: DataFrame, at: Column) -> DataFrame:
    """One row over the last decisions: total, active_waivers, active_acks, expired_waivers, revoked."""
    waived = F.col("kind") == "waive"
    live = F.coalesce(F.col("waived_until") > at, F.lit(False))
    return latest.agg(F.count(F.lit(1)).alias("total"), F.count_if(waived & live).alias("active_waivers"), F.count_if(F.col("kind") == "ack").alias("active_acks"), F.count_if(waived & ~live).alias("expired_waivers"), F.count_if(F.col("kind") == "revoke").alias("revoked"))


def queue_states(items: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """items with state (open, resolved or skipped) and refused: an item is settled once, by its first event; the number of later ones is refused."""
    first = events.groupBy(key).agg(F.min_by("kind", order).alias("_kind"), (F.count(F.lit(1)) - 1).alias("_later"))
    return items.join(first, key, "left").select(*items.columns, F.coalesce("_kind", F.lit("open")).alias("state"), F.coalesce("_later", F.lit(0)).cast("long").alias("refused"))


def valid_decisions(decisions: DataFrame, finding: str, order: str) -> DataFrame:
    """Decisions with the reason they are refused for, null where they stand: waive needs a reason and an end after it is made; revoke needs an earlier decision that isn't a revocation."""
    before = F.lag("kind").over(Window.partitionBy(finding).orderBy(order))
    refused = (
        F.when((F.col("kind") == "waive") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), F.lit("no reason"))
        .when((F.col("kind") == "waive") & F.coalesce(F.col("waived_until") <= F.col("decided_at"), F.lit(True)), F.lit("no end after the decision"))
        .when((F.col("kind") == "revoke") & (before.isNull() | (before == "revoke")), F.lit("nothing to revoke"))
    )
    return decisions.withColumn("refused", refused)


def severity_by_surface(findings: DataFrame, surface: str, severity: str) -> DataFrame:
    """Counts by surface and severity with both margins and the total (null stands for all), and the weighted score."""
    weight = F.lit(0)
    for s, w in SEVERITY_WEIGHT.items():
        weight = F.when(F.col(severity) == s, F.lit(w)).otherwise(weight)
    return findings.withColumn("_w", weight.cast("long")).cube(surface, severity).agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("score"))


def surface_of(entity: Column, rule: Column, by_entity: dict[str, str], patterns: list[tuple[str, str]]) -> Column:
    """A finding's surface: by entity, else by the first pattern that the rule matches, else other."""
    out = F.lit("other")
    for pattern, name in reversed(patterns):
        out = F.when(rule.rlike(pattern), F.lit(name)).otherwise(out)
    for e, name in by_entity.items():
        out = F.when(entity == e, F.lit(name)).otherwise(out)
    return out


def scorecard(results: DataFrame, entity: str, dimension: str, failures: str, evaluated: str) -> DataFrame:
    """Score per entity and dimension: (evaluated - failures) / evaluated, not below 0, 1 where nothing was evaluated; every dimension is there."""
    sums = results.groupBy(entity, dimension).agg(F.sum(failures).cast("double").alias("_f"), F.sum(evaluated).cast("double").alias("_e"))
    spark = results.sparkSession
    all_dims = spark.createDataFrame([(d, w) for d, w in DIMENSIONS.items()], f"{dimension} string, weight double")
    frame = results.select(entity).distinct().crossJoin(F.broadcast(all_dims))
    score = F.when(F.coalesce(F.col("_e"), F.lit(0.0)) > 0, F.greatest(F.lit(0.0), (F.col("_e") - F.col("_f")) / F.col("_e"))).otherwise(F.lit(1.0))
    return frame.join(sums, [entity, dimension], "left").select(entity, dimension, "weight", F.round(score, 4).alias("score"))


def overall(scores: DataFrame, entity: str) -> DataFrame:
    """Weighted score per entity."""
    return scores.groupBy(entity).agg(F.round(F.sum(F.col("score") * F.col("weight")), 4).alias("score"))


def score_change(now: DataFrame, before: DataFrame, entity: str) -> DataFrame:
    """Change per entity against a former snapshot; an entity that was not there counts as 0."""
    return now.join(before.select(entity, F.col("score").alias("_b")), entity, "left").select(entity, "score", F.round(F.col("score") - F.coalesce("_b", F.lit(0.0)), 4).alias("change"))


def overlay(scores: DataFrame, dimension: str, medians: dict[str, float]) -> DataFrame:
    """Each dimension's mean against a benchmark: GREEN from 0.02 above, AMBER from 0.05 below, else RED."""
    spark = scores.sparkSession
    table = spark.createDataFrame(list(medians.items()), f"{dimension} string, benchmark double")
    mean = scores.groupBy(dimension).agg(F.avg("score").alias("mean"))
    gap = F.round(F.col("mean") - F.col("benchmark"), 6)
    return mean.join(F.broadcast(table), dimension).select(dimension, F.round("mean", 4).alias("mean"), "benchmark", F.when(gap >= 0.02, F.lit("GREEN")).when(gap >= -0.05, F.lit("AMBER")).otherwise(F.lit("RED")).alias("rating"))


def narrative_counts(findings: DataFrame, column: str, n: int) -> DataFrame:
    """The n commonest values of a column of findings, ties by value."""
    return findings.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(n)


def reproduce(findings: DataFrame, native: DataFrame, key: str, subject: str = "subject_id") -> DataFrame:
    """Each finding with the native row it speaks of as JSON, or why there is none."""
    rows = native.select(F.col(key).cast("string").alias("_k"), F.to_json(F.struct(*native.columns)).alias("native_row"))
    return findings.join(rows, findings[subject] == rows["_k"], "left").withColumn("unavailable", F.when(F.col(subject).isNull(), F.lit("no subject")).when(F.col("_k").isNull(), F.lit("no native row"))).drop("_k")


def bound_predicate(sql: str, binds: dict[str, object]) -> str:
    """A predicate's text with its :names replaced by their values as literals, but not inside quotes or casts; a name without a value is an error."""

    def literal(x: object) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    def put(m: re.Match) -> str:
        if m[1] is None:
            return m[0]
        if m[1] not in binds:
            raise KeyError(f"no value for :{m[1]}")
        return literal(binds[m[1]])

    return re.sub(r"'(?:[^']|'')*'|::|:([A-Za-z_]\w*)", put, sql)


def reproduction(findings: DataFrame, sides: dict[str, tuple[DataFrame, str]], subject: str = "subject_id") -> DataFrame:
    """Each finding with the row of each side (native, canonical, target, ..) that it speaks of as JSON (side_row), or why there is none (side_unavailable).

    sides: a table and its key by name. A key that a table has several times gives its first row by text.
    """
    out = findings
    for name, (rows, key) in sides.items():
        own = rows.select(F.col(key).cast("string").alias("_k"), F.to_json(F.struct(*rows.columns)).alias(f"{name}_row")).where("_k is not null").groupBy("_k").agg(F.min(f"{name}_row").alias(f"{name}_row"))
        out = out.join(own, F.col(subject) == F.col("_k"), "left")
        out = out.withColumn(f"{name}_unavailable", F.when(F.col(subject).isNull(), F.lit("no subject")).when(F.col("_k").isNull(), F.lit(f"no {name} row"))).drop("_k")
    return out


def narrative(findings: DataFrame, by: tuple[str, ...] = ("severity", "rule_id", "entity_type"), top: int = 5) -> str:
    """A short text on findings from their counts: how many, and the commonest values of some columns. Says so where there are none."""
    total = findings.count()
    if not total:
        return "No findings."
    lines = [f"{total} findings."]
    for column in by:
        counts = narrative_counts(findings, column, top).collect()
        lines.append(f"By {column}: " + ", ".join(f"{r['value']} {r['n']}" for r in counts) + ".")
    return "\n".join(lines)
