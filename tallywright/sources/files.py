"""File extracts, databases and code lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def extract(spark: SparkSession, root: str, entity: str, kind: str = "csv", pattern: str = "{entity}.{kind}", schema: StructType | str | None = None, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8", row_tag: str = "row") -> DataFrame:
    """An entity's extract: csv, json, xml, parquet or orc files whose names follow the pattern; * in it takes several."""
    path = f"{root}/{pattern.format(entity=entity, kind=kind)}"
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, sep=delimiter, header=header, encoding=encoding, multiLine=True, escape='"')
    if kind == "xml":
        return reader.format("xml").option("rowTag", row_tag).option("charset", encoding).load(path)
    if kind == "json":
        return reader.json(path, multiLine=True)
    return reader.format(kind).load(path)


def database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, columns: list[str] | None = None, since: tuple[str, str] | None = None, fetch: int = 1000, **options: str) -> DataFrame:
    """A table over JDBC in parallel key ranges; projection and the since filter are pushed down."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions, fetchsize=fetch, **options).load()
    df = df.select(*columns) if columns else df
    return df.where(F.col(since[0]) >= F.lit(since[1])) if since else df


def query_text(projection: str, where: str | None = None, most: int | None = None) -> str:
    """A query for a database: a projection with a further condition, whether or not it has one already, and at most so many rows."""
    text = f"SELECT * FROM ({projection}) q" + (f" WHERE ({where})" if where else "")
    return text + (f" FETCH FIRST {int(most)} ROWS ONLY" if most is not None else "")


def entity_scan(spark: SparkSession, url: str, projection: str, where: str | None = None, binds: dict[str, object] | None = None, most: int | None = None, fetch: int = 1000, **options: str) -> DataFrame:
    """An entity's projection over JDBC. binds replace :name in the condition, as literals: texts quoted, numbers as they are."""
    for name, value in (binds or {}).items():
        literal = str(value) if isinstance(value, int | float) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"
        where = re.sub(rf":{name}\b", lambda _, x=literal: x, where or "")
    return spark.read.format("jdbc").options(url=url, query=query_text(projection, where, most), fetchsize=fetch, **options).load()


def since(df: DataFrame, column: str, at: str) -> DataFrame:
    """What changed from a time on."""
    return df.where(F.col(column) >= F.lit(at).cast("timestamp"))


def lookup_row(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key: a look at a table."""
    return df.orderBy(key).limit(n)


def describe(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per column: name, type, nullable, whether it is of the key."""
    rows = [(n, f.name, f.dataType.simpleString(), f.nullable, f.name in keys) for n, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean, is_key boolean")


def code_lists(spark: SparkSession, path: str) -> DataFrame:
    """Code lists from JSON files of {id, name, entries: [{code, description, isActive, sortOrder}]}, one row per entry."""
    lists = spark.read.json(path, multiLine=True)
    return lists.select("id", "name", F.explode("entries").alias("e")).select("id", "name", "e.*")


def code_maps(spark: SparkSession, path: str) -> DataFrame:
    """Code maps from JSON files of {id, version, sourceCodelist, targetCodelist, entries: [{sourceCode, targetCode, ..}]}, one row per entry in codes.translate()'s columns, numbered in the order they stand in."""
    entry = "sourceCode string, targetCode string, activeFrom string, activeTo string, tenantId string, notes string"
    maps = spark.read.schema(f"id string, version string, sourceCodelist string, targetCodelist string, tenantId string, entries array<struct<{entry.replace(' string', ':string')}>>").json(path, multiLine=True)
    rows = maps.select("*", F.posexplode("entries").alias("_n", "_e"))
    names = {"sourcecode": "sourceCode", "targetcode": "targetCode", "activefrom": "activeFrom", "activeto": "activeTo", "notes": "notes"}
    return rows.select(F.col("id").alias("map_id"), F.col("version").alias("map_version"), F.col("sourceCodelist").alias("sourcecodelist"), F.col("targetCodelist").alias("targetcodelist"), F.coalesce("_e.tenantId", "tenantId").alias("tenantid"), (F.col("_n") + 1).cast("long").alias("entry_id"), *[F.col(f"_e.{c}").alias(n) for n, c in names.items()])


def picklists(described: DataFrame) -> DataFrame:
    """Code lists of a service's description: rows (object, fields: array of name and values: array of value, label, active) give (list_id, code, description, is_active, position); fields without values give none."""
    fields = described.select("object", F.explode("fields").alias("_f"))
    values = fields.select(F.concat_ws(".", "object", "_f.name").alias("list_id"), F.posexplode("_f.values").alias("position", "_v"))
    return values.select("list_id", F.col("_v.value").alias("code"), F.coalesce("_v.label", "_v.value").alias("description"), F.coalesce("_v.active", F.lit(True)).alias("is_active"), F.col("position").cast("long").alias("position"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A crosswalk corpus from JSON files of {sections: [{entity, fields: [{canonical, banner, sits, notes}]}]} as rows (entity, fields), as mapping.flat_index() takes them."""
    kind = "sections array<struct<entity:string,fields:array<struct<canonical:string,banner:string,sits:string,notes:string>>>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("sections").alias("_s")).select("_s.entity", "_s.fields")


def missing(required: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Required names that aren't present, each once, without regard to case."""
    have = present.select(F.lower(name).alias("_h"))
    return required.select(name).distinct().join(have, F.lower(name) == F.col("_h"), "left_anti")


def stored_audits(records: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """A tenant's last audits, newest first; a list for people, so it has a length."""
    return records.where(F.col("tenant_id") == F.lit(tenant)).orderBy(F.desc("created_at"), F.desc("audit_id")).limit(limit)


def dictionary(fields: DataFrame, entities: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Fields of known entities and the extra ones, in order of entity and name."""
    own = fields.join(entities, key, "left_semi")
    return own.unionByName(extra, allowMissingColumns=True).orderBy(*own.columns[:2])


def grouped_codes(details: DataFrame, lookup: str, code: str, sequence: str) -> DataFrame:
    """One row per lookup with its codes by sequence (nulls last), then code."""
    order = F.struct(F.col(sequence).isNull().alias("n"), F.col(sequence).alias("s"), F.col(code).alias("c"))
    return details.groupBy(lookup).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["c"]).alias("codes"))


def unregistered(columns: DataFrame, name: str, registry: DataFrame, registered: str) -> DataFrame:
    """User-defined columns (.._UDF and a number) that no registry has, without regard to case."""
    known = registry.select(F.upper(registered).alias("_k"))
    return columns.where(F.col(name).rlike(r"(?i)_UDF[0-9]+$")).join(known, F.upper(F.col(name)) == F.col("_k"), "left_anti")


def merged(frames: list[DataFrame]) -> DataFrame:
    """Rows of several resources as one; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def last_by(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of rows with one key the last by ordinal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))).where("_n = 1").drop("_n")
