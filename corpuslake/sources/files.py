"""Files as rows: scan, validation, metadata, decoding, and loading by type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions.clean import clean
from corpuslake.functions.markdown import strip_markdown
from corpuslake.functions.strings import basename, extension
from corpuslake.sources import docx, pdf

TYPES = {".md": "markdown", ".txt": "text", ".pdf": "pdf", ".docx": "word"}
UNKNOWN = "unknown"
OVERSIZE = 100 * 1024 * 1024
BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_type(path: Column) -> Column:
    kind = F.lit(UNKNOWN)
    for suffix, name in TYPES.items():
        kind = F.when(extension(path) == suffix, F.lit(name)).otherwise(kind)
    return kind


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Supported files under root (path, modificationTime, length, content) by lower-cased name; none if root is missing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], BINARY)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.filter(file_type(F.col("path")) != UNKNOWN).orderBy(F.lower(basename(F.col("path"))), "path")


def validated(files: DataFrame) -> DataFrame:
    """Files that are supported and not empty, with a flag for very large ones."""
    return files.filter((F.col("length") > 0) & (file_type(F.col("path")) != UNKNOWN)).withColumn("oversize", F.col("length") > OVERSIZE)


def metadata(files: DataFrame, business_line: str = "", status: str = "active") -> DataFrame:
    """files with the eight metadata columns; doc_id is the MD5 of the content."""
    return files.select(
        *files.columns,
        F.coalesce(F.md5("content"), F.lit("")).alias("doc_id"),
        F.col("path").alias("source"),
        basename(F.col("path")).alias("file_name"),
        file_type(F.col("path")).alias("file_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("updated_at"),
        F.lit(status).alias("status"),
        F.lit(business_line).alias("business_line"),
    )


def decoded(content: Column, codecs: tuple[str, ...] = ("utf-8-sig", "gbk", "latin-1")) -> Column:
    """Text of bytes by the first codec that takes them; valid UTF-8 never leaves the JVM."""

    def other(column):
        import pandas as pd

        def one(data):
            for codec in codecs:
                try:
                    return None if data is None else bytes(data).decode(codec)
                except UnicodeDecodeError:
                    continue
            return None

        return pd.Series([one(d) for d in column], dtype=object)

    text = F.try_validate_utf8(content.cast("string"))
    rest = F.pandas_udf(other, "string")(F.when(text.isNull(), content))
    return F.regexp_replace(F.coalesce(text, rest), r"\A\x{feff}", "") if "utf-8-sig" in codecs else F.coalesce(text, rest)


def load_text(content: Column) -> Column:
    return clean(decoded(content), ocr=True)


def load_markdown(content: Column) -> Column:
    return strip_markdown(decoded(content, ("utf-8", "gbk")))


def load(files: DataFrame, pdf_parser: pdf.Parser | None = None) -> DataFrame:
    """files (with path and content), text and load_error; what gives no text is dropped but for files whose parser failed."""
    kinds: dict[str, Callable[[DataFrame], DataFrame]] = {
        "text": lambda df: df.withColumn("text", load_text(F.col("content"))),
        "markdown": lambda df: df.withColumn("text", load_markdown(F.col("content"))),
        "word": lambda df: df.withColumn("text", clean(docx.text_of(F.col("content")), ocr=False)),
    }
    if pdf_parser is not None:
        kinds["pdf"] = lambda df: pdf.with_text(df, pdf_parser)
    parts = [f(files.filter(file_type(F.col("path")) == kind)) for kind, f in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out if "load_error" in out.columns else out.withColumn("load_error", F.lit(None).cast("string"))
    return out.filter("text <> '' OR load_error IS NOT NULL")
