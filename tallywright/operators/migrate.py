"""Row transforms of a migration: numbers, terms, attempts, validation, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions.values import is_blank
from tallywright.session import cut, small


def text_hash(c: Column) -> Column:
    """31-multiplier hash of a text in 32-bit arithmetic."""
    wrap = lambda x: F.when(x >= F.lit(1 << 31), x - F.lit(1 << 32)).otherwise(x)
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: wrap(F.pmod(acc * 31 + x, F.lit(1 << 32))))


def hashed_number(c: Column, buckets: int) -> Column:
    """A number below buckets for a text; texts may share one, see collisions()."""
    return F.abs(text_hash(c)) % buckets


def collisions(df: DataFrame, text: str, number: str) -> DataFrame:
    """Numbers that more than one text got."""
    return df.groupBy(number).agg(F.count_distinct(text).alias("texts")).where("texts > 1")


def pad(c: Column, width: int) -> Column:
    """Zeros before a text up to a width; longer texts stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def number_rows(df: DataFrame, order: list[str], start: int, width: int, name: str = "number") -> DataFrame:
    """df with consecutive zero-padded numbers in order, without gathering it: positions inside range partitions plus the sizes of those before."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = small(sizes.select(F.col("_pid").alias("_p"), F.col("_first"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    ranked = placed.join(offsets, F.col("_pid") == F.col("_p")).withColumn(name, pad((F.col("_before") + F.col("_mid") - F.col("_first") + start).cast("string"), width))
    return ranked.select(*df.columns, name)


def attempts(df: DataFrame, keys: list[str], order: list[str], start: int = 1) -> DataFrame:
    """df with attempt, counted per key in order."""
    return df.withColumn("attempt", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) + (start - 1)).cast("long"))


def credits_to_cats(c: Column, rounding: str = "nearest", factor: float = 3.75) -> Column:
    """Credits times a factor, rounded half up, down or up."""
    x = c.cast("double") * factor
    return {"nearest": F.floor(x + 0.5), "floor": F.floor(x), "ceil": F.ceil(x)}[rounding].cast("long")


def term_year(c: Column, style: str = "YYYY/Y") -> Column:
    """The academic year of a term that starts with its year."""
    y = F.regexp_extract(c, r"^(\d{4})", 1)
    n = F.when(y != "", y.cast("int"))
    return {"YYYY/Y": F.concat(y, F.lit("/"), ((n + 1) % 10).cast("string")), "YYYY-YYYY": F.concat(y, F.lit("-"), (n + 1).cast("string")), "YYYY": F.when(n.isNotNull(), y)}[style]


def lookup(df: DataFrame, column: str, table: dict[str, str], name: str, default: str | None = None) -> DataFrame:
    """df with a code's translation, or the default; the table is given, so it is small."""
    m = df.sparkSession.createDataFrame(list(table.items()) or [("", "")], "_k string, _v string")
    joined = df.join(small(m), F.col(column) == F.col("_k"), "left")
    return joined.select(*df.columns, (F.coalesce("_v", F.lit(default)) if default is not None else F.col("_v")).alias(name))


def missing_fields(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """One row (key, field) for every required field that is blank."""
    gaps = F.filter(F.array(*[F.when(is_blank(F.col(c).cast("string")), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(gaps).alias("field"))


def stage(df: DataFrame, key: str, required: list[str], existing: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """df with op (create, update or skip) and reason: rows that fail validation are skipped, never written; a dry run skips all."""
    gaps = F.concat_ws(",", F.filter(F.array(*[F.when(is_blank(F.col(c).cast("string")), F.lit(c)) for c in required]), lambda x: x.isNotNull()))
    known = existing.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(True)) if existing is not None else None
    rows = df.join(known, F.col(key) == F.col("_k"), "left") if known is not None else df.withColumn("_in", F.lit(None).cast("boolean"))
    op = F.when(gaps != "", F.lit("skip")).when(F.lit(dry_run), F.lit("skip")).when(F.col("_in"), F.lit("update")).otherwise(F.lit("create"))
    reason = F.when(gaps != "", F.concat(F.lit("missing "), gaps)).when(F.lit(dry_run), F.lit("dry run")).otherwise(F.lit(""))
    return rows.select(*df.columns, op.alias("op"), reason.alias("reason"))


def totals(staged: DataFrame, entity: Column) -> DataFrame:
    """Rows by entity and op."""
    return staged.groupBy(entity.alias("entity"), "op").agg(F.count(F.lit(1)).alias("n"))


def rollback(written: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """What stays when a batch's rows are taken out."""
    return written.join(batch.select(key).distinct(), key, "left_anti")


def commit(staged: DataFrame, path: str, entity: str) -> None:
    """Writes the rows to create or update, one folder per entity."""
    staged.where(F.col("op").isin("create", "update")).write.mode("append").partitionBy(entity).parquet(path)


def required_fields(required: DataFrame, present: DataFrame, keys: tuple[str, str] = ("table_name", "field")) -> DataFrame:
    """Each required field with its verdict: ok, missing, or unknown where nothing is known of its table."""
    table, name = keys
    have = present.select(F.lower(table).alias("_t"), F.lower(name).alias("_f")).distinct()
    tables = have.select(F.col("_t").alias("_tt")).distinct().withColumn("_known", F.lit(True))
    met = required.join(have.withColumn("_in", F.lit(True)), (F.lower(table) == F.col("_t")) & (F.lower(name) == F.col("_f")), "left").join(tables, F.lower(table) == F.col("_tt"), "left")
    return met.select(table, name, F.when(F.col("_in"), F.lit("ok")).when(F.col("_known"), F.lit("missing")).otherwise(F.lit("unknown")).alias("verdict"))


def fill_gap(df: DataFrame, column: str, due: Column, default: str | None = None) -> DataFrame:
    """df with the column filled where it is due and blank, and gap: filled with a default, else queued; null where there is no gap."""
    gap = F.coalesce(due, F.lit(False)) & is_blank(F.col(column).cast("string"))
    filled = F.when(gap & F.lit(default is not None), F.lit(default)).otherwise(F.col(column))
    return df.withColumns({"gap": F.when(gap, F.lit("filled" if default is not None else "queued")), column: filled})
