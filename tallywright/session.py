"""Session helpers: where lineage is cut, what may be broadcast, how tables are read."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be gathered on the driver and broadcast. Counted before, never assumed.
BROADCAST_ROWS = 100_000


def local_session(app: str = "tallywright", cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which the session names in spark.checkpoint.dir.

    Only a local session may leave it out, as tests do: there one is made. On a cluster a folder of one
    machine would lose what the others wrote, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="tallywright-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that the loss of an executor loses nothing.

    Spark removes the files of a frame that is no longer used where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as a broadcast table if it has at most max_rows rows, else df as it is, for a shuffled join.

    The rows are counted by fetching max_rows + 1 of them, so the bound holds whatever the data.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """A number of partitions for work that is heavy for its bytes: as many as the session shuffles into, more where rows ask for it.

    Adaptive execution sizes partitions by bytes and would leave such work to a few tasks.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows // per_task))
