"""Materialisation in the folder that driver and executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast; beyond, the join shuffles both sides.
BROADCAST_ROWS = 100_000

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all run in one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="corpuslake-"))
    return _own[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/corpuslake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: a table of few row groups before heavy expressions."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def wide(spark: SparkSession) -> int:
    """Partitions for steps whose work is large beside their bytes, so that they aren't coalesced to a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 2_048, 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small on both sides of the Python boundary.

    Sets the limits of rows and bytes for the session unless they have been set to other values than Spark's defaults; they
    are read when a plan is run, so they stay set.
    """
    conf = df.sparkSession.conf
    for key, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if conf.get(f"spark.sql.execution.arrow.{key}", None) == default:
            conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return df


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it proves to have few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
