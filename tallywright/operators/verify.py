"""Two systems side by side: field verification, its scores, and what an integration would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK_EQUAL = False


def _long(df: DataFrame, key: str, fields: list[str], side: str) -> DataFrame:
    text = [F.struct(F.lit(f).alias("field"), canonical_text(df, f).alias("value")) for f in fields]
    return df.select(F.col(key).alias(key), F.explode(F.array(*text)).alias("_x")).select(key, F.col("_x.field").alias("field"), F.col("_x.value").alias(f"v_{side}"), F.lit(True).alias(f"in_{side}"))


def canonical_text(df: DataFrame, c: str) -> Column:
    """A value as text; numbers without a needless fraction, so that 1 and 1.0 are one."""
    kind = dict(df.dtypes)[c]
    if kind in ("double", "float"):
        return F.when(F.col(c) == F.floor(F.col(c)), F.col(c).cast("decimal(38,0)").cast("string")).otherwise(F.col(c).cast("string"))
    return F.col(c).cast("string")


def verify_fields(a: DataFrame, b: DataFrame, key: str, fields: list[str], blanks_equal: bool = BLANK_EQUAL) -> DataFrame:
    """Rows (key, field, status): every field of every record as match, mismatch, null-in-a/b or missing-in-a/b.

    A record on one side only has one row with field <record>. Both blank is a match with
    blanks_equal; else null and null match, null and "" do not.
    """
    left, right = _long(a, key, fields, "a"), _long(b, key, fields, "b")
    both = left.join(right, [key, "field"], "full_outer")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    equal = F.col("v_a").eqNullSafe(F.col("v_b"))
    if blanks_equal:
        equal = equal | (blank("v_a") & blank("v_b"))
    status = (
        F.when(F.col("in_b").isNull(), F.lit("missing-in-b"))
        .when(F.col("in_a").isNull(), F.lit("missing-in-a"))
        .when(equal, F.lit("match"))
        .when(blank("v_a") & ~blank("v_b"), F.lit("null-in-a"))
        .when(blank("v_b") & ~blank("v_a"), F.lit("null-in-b"))
        .otherwise(F.lit("mismatch"))
    )
    rows = both.select(key, "field", status.alias("status"))
    lone = F.col("status").startswith("missing")
    # a record's fields are all missing together: the first of them speaks for it
    return rows.where(~lone | (F.col("field") == fields[0])).withColumn("field", F.when(lone, F.lit("<record>")).otherwise(F.col("field")))


def verify_scores(diff: DataFrame) -> DataFrame:
    """Comparisons, matches and their share, by field and over all (null field)."""
    compared = diff.where("field != '<record>'")
    n, same = F.count(F.lit(1)), F.count_if(F.col("status") == "match")
    return compared.rollup("field").agg(n.alias("comparisons"), same.alias("matches"), F.round(same / n, 6).alias("score"))


def prep_verdicts(source: DataFrame, target: DataFrame, key: str, fields: list[str], reject: Column | None = None, ordinal: str | None = None) -> DataFrame:
    """Rows (key, verdict, deltas): what loading source into target would do.

    In order: reject where the test says so, skip without a key, create without a target, skip
    without differences, else update. Of target rows with one key the last by ordinal counts.
    """
    cols = [F.col(f).cast("string").alias(f"_t_{f}") for f in fields]
    t = target.select(F.col(key).alias("_k"), *cols, *([F.col(ordinal).alias("_o")] if ordinal else []), F.lit(True).alias("_in"))
    if ordinal:
        t = t.groupBy("_k").agg(F.max_by(F.struct(*[f"_t_{f}" for f in fields]), "_o").alias("_s"), F.lit(True).alias("_in")).select("_k", "_s.*", "_in")
    both = source.withColumn("_r", F.coalesce(reject, F.lit(False)) if reject is not None else F.lit(False)).join(t, source[key] == t["_k"], "left")
    deltas = F.concat_ws(",", F.filter(F.array(*[F.when(~F.col(f).cast("string").eqNullSafe(F.col(f"_t_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
    no_key = F.col(key).isNull() | (F.col(key).cast("string") == "")
    verdict = F.when(F.col("_r"), F.lit("reject")).when(no_key, F.lit("skip")).when(F.col("_in").isNull(), F.lit("create")).when(deltas == "", F.lit("skip")).otherwise(F.lit("update"))
    return both.select(F.col(key), verdict.alias("verdict"), F.when(verdict == "update", deltas).otherwise(F.lit("")).alias("deltas"))
