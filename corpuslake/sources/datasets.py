"""Evaluation datasets and chat sessions from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import schemas

BUILTIN = [
    ("What does retrieval add to a language model's answers?", ["retrieval", "检索"]),
    ("Which index finds similar vectors?", ["vector", "向量"]),
    ("How are long documents prepared for search?", ["chunk", "切片"]),
]


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, relevant_texts) of a JSON array; fails if the file is missing or no array of objects."""
    rows = spark.read.schema(schemas.EVAL).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return numbered(rows)


def builtin_dataset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate(BUILTIN)], "query_id bigint, question string, relevant_texts array<string>")


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("query_id", F.monotonically_increasing_id()).select("query_id", "question", "relevant_texts")


def save_sessions(sessions: DataFrame, path: str) -> None:
    """Writes chat sessions as load_sessions reads them: one JSON object a file, null fields included."""
    sessions.select("name", "messages", "created_at").write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(path)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Chat sessions, one JSON object a file; broken files give null columns."""
    return spark.read.schema(schemas.SESSIONS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
