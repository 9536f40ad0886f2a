"""What the operators share: table access, shared-folder materialisation, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where all run in one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="corpuslake-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corpuslake/{label}-{uuid.uuid4().hex}"


#: Whether a query's shuffle files are deleted when it ends; read when a query begins.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts the lineage without localCheckpoint: a lost executor costs nothing that was finished. The shuffle files of the
    write go when it ends, and don't wait until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; for intermediate tables that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one number each (a few MB) up to which a counted set of keys is broadcast; beyond, the join shuffles.
BROADCAST_KEYS = 200_000


def without_keys(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of df whose key isn't among gone (row_key), which is written and counted first."""
    gone = materialize(gone.select("row_key").distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    return df.join(few, key == few.row_key, "left_anti")


#: Bits of a bitmap (2 MB).
BITMAP = 2**24


def bitmap_of(keys: DataFrame) -> DataFrame:
    """One row (_one, _bitmap) for the values of a one-column frame: a bit for the hash of each, whatever their number."""
    spark = keys.sparkSession
    spot = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(BITMAP))
    marked = keys.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 AS int)))").alias("bits"))
    every = spark.range(BITMAP >> 6, numPartitions=1).join(marked, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])  # as long as the bitmap
    return materialize(every.agg(whole.alias("_bitmap")).withColumn("_one", F.lit(1)), "bitmap")


def maybe_in(value: Column) -> Column:
    """Whether the bitmap beside (_bitmap) has the value's bit; values that share a bit with another pass too."""
    spot = F.pmod(F.xxhash64(value), F.lit(BITMAP))
    word = F.get(F.col("_bitmap"), F.shiftright(spot, 6).cast("int"))
    return F.call_function("shiftright", word, spot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def few_or_all(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows, to be broadcast if these are few."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df less rows whose column certainly isn't among keys (one column), so that less is shuffled to the join that must follow.

    The bitmap has a fixed size and is broadcast as one row; with very many keys all rows pass.
    """
    beside = df.withColumn("_one", F.lit(1)).join(F.broadcast(bitmap_of(keys)), "_one")  # one row
    return beside.filter(maybe_in(F.col(column))).select(*(F.col(f"`{c}`") for c in df.columns))


def row_key(doc_id: Column | str, text: Column | str) -> Column:
    """16 bytes that stand for an id and a text together; nulls differ from any value."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), F.lit("?")).otherwise(F.concat(F.lit("="), text)))
    return F.unhex(F.md5(said.cast("binary")))


#: Rows of an Arrow batch, where the session has Spark's default.
BATCH_ROWS = 2_048


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches of whole texts are small on both sides of the Python boundary.

    This sets spark.sql.execution.arrow.maxRecordsPerBatch for the session unless it has been set to another value than
    Spark's default; it is read when a plan is run, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, text: int, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most so many rows and, but for a single longer text, so many bytes of its text column."""
    ends = np.cumsum(np.fromiter((x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()), np.int64, batch.num_rows))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        n = min(max(int(np.searchsorted(ends, before + size, side="right")) - at, 1), rows)
        yield batch.slice(at, n)
        at += n


def wide(spark: SparkSession) -> int:
    """Partitions for steps whose work is large beside their bytes, so that they aren't coalesced to a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array: runs of digits, a-z and non-ASCII characters; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP, -1), "")


def fold(column: str, remainder: int, modulus: int) -> Column:
    """True for rows whose crc32 of the id's decimal text leaves this remainder; null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
