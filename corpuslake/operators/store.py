"""The chunk store: a Parquet table in partitions by a bucket of the source; a change writes the buckets it touches.

New content is written beside the table (`.next`) as a partitioned table of its own. Then a folder `_commit` that names the
buckets appears there in one rename: from here the change counts. Last, the buckets' folders (or, of added rows, their
files) are moved into the table. `recover` goes on where a writer was stopped: without the commit what was written
beside is dropped, with it the moves that are left are made, so that after it the table is the old one or the new one.
There is one writer at a time, and renames of folders have to be atomic, as they are on HDFS and local disks. A source of
very many chunks makes its bucket large, but the bucket's files are of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import schemas
from corpuslake.functions.strings import basename

#: Partitions of the table.
BUCKETS = 64


def bucket(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


def bucket_of(spark: SparkSession, source: str | None) -> int:
    return spark.range(1).select(bucket(F.lit(source).cast("string"))).first()[0]


def buckets(rows: DataFrame) -> list[int]:
    """The buckets of rows with a source."""
    return sorted(r[0] for r in rows.select(bucket(F.col("source"))).distinct().collect())  # BUCKETS at most


def add(chunks: DataFrame, path: str) -> None:
    """Appends chunks; columns that are missing are null."""
    recover(chunks.sparkSession, path)
    _stage(chunks, path)
    _commit(chunks.sparkSession, path, ["add"])


def scan(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table's rows, or those of some buckets, whose folders alone are read."""
    rows = spark.read.schema(f"{schemas.CHUNKS}, bucket int").parquet(path)
    return (rows if only is None else rows.filter(F.col("bucket").isin(only))).drop("bucket")


def replace(rows: DataFrame, path: str, changed: list[int]) -> None:
    """Makes rows, which may be read from the table, the whole content of the changed buckets."""
    spark = rows.sparkSession
    recover(spark, path)
    _stage(rows, path)
    written = {p.getName() for p in _listed(spark, f"{_next(path)}") if p.getName().startswith("bucket=")}
    if not written <= {f"bucket={b}" for b in changed}:
        raise ValueError("rows of other buckets")
    _commit(spark, path, [*(f"set.{b}" for b in changed if f"bucket={b}" in written), *(f"clear.{b}" for b in changed if f"bucket={b}" not in written)])


def recover(spark: SparkSession, path: str) -> None:
    """Ends or undoes a change that was stopped."""
    if not _exists(spark, _next(path)):
        return
    if _exists(spark, f"{_next(path)}/_commit"):
        _apply(spark, path)
    else:
        _delete(spark, _next(path))


def _next(path: str) -> str:
    return path.rstrip("/") + ".next"


def _at(spark: SparkSession, path: str):
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here, here.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    here, fs = _at(spark, path)
    return fs.exists(here)


def _listed(spark: SparkSession, path: str) -> list:
    here, fs = _at(spark, path)
    return [f.getPath() for f in fs.listStatus(here)] if fs.exists(here) else []


def _delete(spark: SparkSession, path: str) -> None:
    here, fs = _at(spark, path)
    fs.delete(here, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    here, fs = _at(spark, old)
    there, _ = _at(spark, new)
    fs.mkdirs(there.getParent())
    if not fs.rename(here, there):
        raise OSError(f"{old} could not be renamed to {new}")


def _stage(rows: DataFrame, path: str) -> None:
    wanted = rows.sparkSession.createDataFrame([], schemas.CHUNKS).schema
    placed = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted)).withColumn("bucket", bucket(F.col("source")))
    placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(_next(path))


def _commit(spark: SparkSession, path: str, names: list[str]) -> None:
    plan, fs = _at(spark, f"{_next(path)}/_plan")
    fs.mkdirs(plan)
    for name in names:
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(plan, name), True).close()
    _rename(spark, f"{_next(path)}/_plan", f"{_next(path)}/_commit")
    _apply(spark, path)


def _apply(spark: SparkSession, path: str) -> None:
    """Makes the moves of a committed change that haven't been made."""
    here, fs = _at(spark, path)
    fs.mkdirs(here)
    for name in (p.getName() for p in _listed(spark, f"{_next(path)}/_commit")):
        kind, _, number = name.partition(".")
        if kind == "add":
            for folder in _listed(spark, _next(path)):
                if folder.getName().startswith("bucket="):
                    for file in _listed(spark, folder.toString()):
                        _rename(spark, file.toString(), f"{path}/{folder.getName()}/{file.getName()}")
        elif kind == "clear":
            _delete(spark, f"{path}/bucket={number}")
        elif _exists(spark, f"{_next(path)}/bucket={number}"):  # else it has been moved
            _delete(spark, f"{path}/bucket={number}")
            _rename(spark, f"{_next(path)}/bucket={number}", f"{path}/bucket={number}")
    _delete(spark, _next(path))


def without_source(store: DataFrame, source: str) -> DataFrame:
    return store.filter(~F.col("source").eqNullSafe(F.lit(source)))


def count_source(store: DataFrame, source: str) -> DataFrame:
    return store.filter(F.col("source") == source).agg(F.count("*").alias("deleted"))


def set_active(store: DataFrame, source: str, active: bool, version: int | None = None) -> DataFrame:
    """store with is_active changed for a source, or for one version of it."""
    hit = F.col("source") == source
    if version is not None:
        hit = hit & (F.col("version").cast("int") == version)
    return store.withColumn("is_active", F.when(hit, F.lit(active)).otherwise(F.col("is_active")))


def source_versions(store: DataFrame, source: str | None = None) -> DataFrame:
    """Distinct versions of sources, in numeric order."""
    rows = store if source is None else store.filter(F.col("source") == source)
    return rows.select("source", F.col("version").cast("int").alias("version")).filter("version IS NOT NULL").distinct().orderBy("source", "version")


def stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"))


def sources(store: DataFrame) -> DataFrame:
    return store.select("source").filter("source IS NOT NULL").distinct().orderBy(F.lower(basename(F.col("source"))), "source")


def rows_at(ordinals: DataFrame, store: DataFrame, columns: list[str], doc: str = "doc") -> DataFrame:
    """ordinals with these columns of the stored row at each; null where there is none."""
    return ordinals.join(store.select(doc, *columns), doc, "left")


def session_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): two messages make a turn."""
    return conversations.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("turns"))


def last_message(conversations: DataFrame) -> DataFrame:
    """(conv_id, role, text) of each conversation's last message."""
    return conversations.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m")).select("conv_id", "m.role", "m.text")
