"""Chat sessions as rows (name, messages, created_at): create, append, rename, delete, pick and count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake import schemas


def created(sessions: DataFrame, name: str, created_at: str) -> DataFrame:
    """sessions with an empty one more, unless the name is taken."""
    spark: SparkSession = sessions.sparkSession
    new = spark.createDataFrame([(name, [], created_at)], schemas.SESSIONS)
    return sessions.unionByName(new.join(sessions.select("name"), "name", "left_anti").select(*sessions.columns))


def appended(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions with each one's new messages (name, seq, role, content, sources) behind its old ones, in order of seq."""
    fields = F.struct("role", "content", "sources")
    new = messages.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", fields.alias("m")))), lambda x: x["m"]).alias("new"))
    joined = sessions.join(new, "name", "left")
    return joined.select("name", F.when(F.col("new").isNotNull(), F.concat("messages", "new")).otherwise(F.col("messages")).alias("messages"), "created_at")


def renamed(sessions: DataFrame, old: str, new: str) -> DataFrame:
    return sessions.withColumn("name", F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name")))


def deleted(sessions: DataFrame, name: str) -> DataFrame:
    return sessions.filter(~F.col("name").eqNullSafe(F.lit(name)))


def latest(sessions: DataFrame) -> DataFrame:
    """The session that was created last, ties by name."""
    return sessions.orderBy(F.col("created_at").desc_nulls_last(), "name").limit(1)


def turns(sessions: DataFrame) -> DataFrame:
    """(name, turns): two messages make a turn."""
    return sessions.select("name", F.floor(F.coalesce(F.size("messages"), F.lit(0)) / 2).alias("turns"))
