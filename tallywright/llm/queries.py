"""The queries of this package's operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.matching import match
from tallywright.llm.names import variants
from tallywright.llm.packing import CAPACITY, pack
from tallywright.llm.persons import people
from tallywright.llm.reading import reading_bands
from tallywright.llm.tokens import decode, encode
from tallywright.session import cut, table


def cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    banner, sits = table(spark, sf_dir, "spriden"), table(spark, sf_dir, "stu")
    records = people(banner, 0, F.col("spriden_pidm"), "spriden_first_name", "spriden_mi", "spriden_last_name", "spriden_birth_date", "email", "postcode").unionByName(
        people(sits, 1, F.col("stu_code"), "stu_fore", None, "stu_surn", "stu_dob", "email", "postcode")
    )
    return match(records)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_reference(spark, sf_dir).select(F.col("a").cast("bigint").alias("spriden_pidm"), F.col("b").alias("stu_code"))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_reference(spark, sf_dir).select(F.col("a").cast("bigint").alias("spriden_pidm"), F.col("b").alias("stu_code"), F.round("confidence", 6).alias("confidence"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    student, person = table(spark, sf_dir, "student"), table(spark, sf_dir, "spriden")
    records = people(student, 0, F.col("id"), "firstname", "middlenames", "lastname", "dateofbirth", "email", None, numbered=True).unionByName(
        people(person, 1, F.col("spriden_pidm"), "spriden_first_name", "spriden_mi", "spriden_last_name", "spriden_birth_date", "email", "postcode", numbered=True)
    )
    keys = student.select(F.lit(0).alias("source"), F.col("id").alias("key")).unionByName(person.select(F.lit(1).alias("source"), F.col("spriden_pidm").cast("string").alias("key")))
    names = F.when(F.col("source") == 0, F.lit("student")).otherwise(F.lit("spriden"))
    return variants(records, keys=keys).select(names.alias("source_table"), "key_1", "key_2")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(encode(table(spark, sf_dir, "documents"), lengths_only=True), "doc_id", "n_tokens")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ids of each document stand for, which must be its text."""
    return decode(p8_ids(spark, sf_dir)).select("doc_id", F.md5("bytes").alias("digest"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row that counts the documents placed and what must not be: containers above the capacity, small documents in pieces, documents with a gap or an overlap between pieces or that aren't whole."""
    sizes = encode(table(spark, sf_dir, "documents"), lengths_only=True)
    placed = cut(pack(sizes, "doc_id", "n_tokens"))
    over = placed.groupBy("container_id").agg(F.sum("size").alias("size")).where(F.col("size") > CAPACITY)
    documents = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("size"), F.max(F.col("start") + F.col("size")).alias("last"), F.max("start").alias("start")).join(sizes, "doc_id", "full_outer")
    split = F.count_if((F.col("pieces") > 1) & (F.col("size") <= CAPACITY))
    broken = F.count_if(~F.coalesce((F.col("size") == F.col("n_tokens")) & (F.col("last") == F.col("n_tokens")) & (F.col("start") == (F.col("pieces") - 1) * CAPACITY), F.lit(False)))
    return documents.agg(F.count(F.lit(1)).alias("documents"), split.alias("split"), broken.alias("broken")).crossJoin(over.agg(F.count(F.lit(1)).alias("overfull")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p3_found, p8_ids, p8_round_trip, p9_containers, p9_invariants, p10_found)}
SQL: dict[str, str] = {
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_invariants": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS overfull FROM documents",
}
