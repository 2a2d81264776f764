"""Incremental forms of audits: rules, windows, first-seen duplicates and running state over streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallywright.rules.engine import run_rules


def stream_files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def stream_findings(rows: DataFrame, rules: list, entity: str, key: str) -> DataFrame:
    """Row rules over a stream: stateless, so a finding comes once for each row that comes."""
    return run_rules(rows, rules, entity, key)


def windowed_counts(rows: DataFrame, at: str, late: str, length: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts per window and keys; rows later than `late` behind the newest are left out."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(rows: DataFrame, at: str, late: str, gap: str, key: str) -> DataFrame:
    """Counts per key and session, which ends after a gap without rows."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(rows: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key; state is kept for as long as rows may be late."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what is there and ends; a second call goes on where the first one ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def kept(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives over what is there, written under a folder and read back: rows as they come (append), or the last state (complete). A second call goes on."""

    def each(rows: DataFrame, _: int) -> None:
        rows.write.mode("append" if mode == "append" else "overwrite").parquet(f"{folder}/rows")

    run_available(stream, f"{folder}/checkpoint", each, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
