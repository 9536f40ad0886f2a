"""Incremental ingestion: a file-source stream whose micro-batches run the batch index, each of them once.

A micro-batch is known by its stream and number. Its refused files are one folder of the table `refused`, written over
by a second run of the batch; its row of the ledger `batches` is written last, and a batch that the ledger has is
skipped. A batch that was stopped in between is run again: files that it stored are found by content hash, and what it
didn't log is logged, so the tables are those of one run.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslake import schemas
from corpuslake.engine import Engine
from corpuslake.sources import files

LISTING = "path", "modificationTime", "length"


def arrivals(engine: Engine, root: str, max_files: int = 100) -> DataFrame:
    """New files under root as a stream of paths, times and lengths; contents are read later, of accepted files only."""
    raw = engine.spark.readStream.format("binaryFile").schema(files.BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    return raw.select(*LISTING)


def reason(engine: Engine) -> Column:
    """Why a file isn't taken, or null."""
    large = F.when(F.col("length") > engine.config.upload_limit_bytes, F.lit("over the upload limit"))
    unknown = F.when(files.file_type(F.col("path")) == files.UNKNOWN, F.lit("unknown file type"))
    return F.coalesce(large, unknown)


def refused(engine: Engine, root: str) -> DataFrame:
    """(path, length, reason) of the files under root that a stream leaves out."""
    found = engine.spark.read.format("binaryFile").schema(files.BINARY).option("recursiveFileLookup", True).load(root).select("path", "length")
    return found.withColumn("reason", reason(engine)).filter("reason IS NOT NULL")


def batches(engine: Engine) -> DataFrame:
    """The ledger: finished batches with how many files they took and refused."""
    return engine._table("batches", schemas.BATCHES)


def refusals(engine: Engine) -> DataFrame:
    """Files that batches refused."""
    return engine._table("refused", schemas.REFUSED)


def take(engine: Engine, listed: DataFrame, batch_id: int, stream: str, semantic: bool = False) -> bool:
    """Indexes the files of a micro-batch (path, length); False if the ledger has the batch.

    Paths come to the driver: a trigger lists max_files of them at most.
    """
    place = f"stream={stream}/batch_id={batch_id}"
    if engine._exists(f"batches/{place}") and not engine.spark.read.schema("files bigint").parquet(f"{engine.home}/batches/{place}").isEmpty():
        return False
    told = [(r.path, r.length, r.reason) for r in listed.select("path", "length", reason(engine).alias("reason")).collect()]
    out = [t for t in told if t[2]]
    paths = [re.sub(r"([*?{}\[\]\\])", r"\\\1", p) for p, _, why in told if not why]  # a path isn't a pattern
    engine.spark.createDataFrame(out, "path string, length bigint, reason string").coalesce(1).write.mode("overwrite").parquet(f"{engine.home}/refused/{place}")
    if paths:
        engine.index_files(engine.spark.read.format("binaryFile").schema(files.BINARY).load(paths), semantic=semantic, replace=True)
    row = engine.spark.range(1).select(F.lit(len(paths)).cast("long").alias("files"), F.lit(len(out)).cast("long").alias("refused"), F.current_timestamp().alias("finished_at"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{engine.home}/batches/{place}")
    return True


def start(engine: Engine, root: str, checkpoint: str, max_files: int = 100, semantic: bool = False, once: bool = False) -> StreamingQuery:
    """Indexes every micro-batch once; a source that is stored already has its chunks replaced.

    A file source takes each path once: a changed file comes in under a new path, or by Engine.index. A stream is named
    by its checkpoint.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def run(batch: DataFrame, batch_id: int) -> None:
        take(engine, batch, batch_id, stream, semantic)

    writer = arrivals(engine, root, max_files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()
