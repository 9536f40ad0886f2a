"""Versions: an append-only log of indexing events and one of active pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_log(events: DataFrame) -> DataFrame:
    """events (doc_id, file_name, chunk_count, seq) with version, previous_chunk_count and delta."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    before = F.lag("chunk_count", 1, 0).over(w)
    return events.select("*", F.row_number().over(w).alias("version"), before.alias("previous_chunk_count")).withColumn("delta", F.col("chunk_count") - F.col("previous_chunk_count"))


def list_versions(log: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Newest first."""
    found = log if doc_id is None else log.filter(F.col("doc_id") == doc_id)
    return found.orderBy("doc_id", F.col("version").desc())


def rollbacks(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, target, seq) with `done`: whether the document has that version."""
    counts = log.groupBy("doc_id").agg(F.max("version").alias("versions"))
    joined = wanted.join(counts, "doc_id", "left")
    return joined.select("doc_id", "target", "seq", F.coalesce(F.col("target").between(1, F.col("versions")), F.lit(False)).alias("done"))


def pointers(log: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, version, seq): every indexing points at its version, every rollback that is done at its target."""
    out = log.select("doc_id", F.col("version").cast("int").alias("version"), F.col("seq").cast("long").alias("seq"))
    if wanted is not None:
        out = out.unionAll(rollbacks(log, wanted).filter("done").select("doc_id", F.col("target").cast("int"), F.col("seq").cast("long")))
    return out


def active_versions(pointer_log: DataFrame, doc_ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, active_version): the latest pointer; 0 for asked ids without any."""
    latest = pointer_log.groupBy("doc_id").agg(F.max_by("version", "seq").alias("active_version"))
    if doc_ids is None:
        return latest
    return doc_ids.select("doc_id").distinct().join(latest, "doc_id", "left").select("doc_id", F.coalesce("active_version", F.lit(0)).alias("active_version"))


def safe_id(c):
    """An id that can be a file's name."""
    return F.translate(c, "/\\", "__")
