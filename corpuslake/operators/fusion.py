"""Rank fusion of a keyword list and a vector list, for all queries at once.

Lists are rows (query_id, doc, score, rank); a doc may occur twice in one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig

CONFIG = EngineConfig()


def _with_rank(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def reciprocal_rank(keyword: DataFrame, vector: DataFrame, k: int = CONFIG.rrf_k) -> DataFrame:
    """Sum of 1 / (k + rank) over both lists, rounded; ties go to what comes first, the keyword list before the vector list."""
    tagged = [df.select("query_id", "doc", "rank", F.lit(i).alias("list")) for i, df in enumerate((keyword, vector))]
    scores = tagged[0].unionAll(tagged[1]).groupBy("query_id", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    return _with_rank(scores, F.col("score").desc(), F.col("first")).select("query_id", "doc", "score", "rank")


def linear(keyword: DataFrame, vector: DataFrame, keyword_weight: float = CONFIG.keyword_weight, vector_weight: float = CONFIG.vector_weight) -> DataFrame:
    """Weighted sum of min-max scaled vector scores and keyword scores over their maximum.

    Of a doc that occurs twice in the vector list the last occurrence counts, in the keyword list all do; ties go
    to the vector list's order, then to the keyword list's.
    """
    bounds = vector.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    v = vector.groupBy("query_id", "doc").agg(F.max_by("score", "rank").alias("score"), F.min("rank").alias("v_rank")).join(bounds, "query_id")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    v = v.select("query_id", "doc", ((F.col("score") - F.col("lo")) / width * vector_weight).alias("v"), "v_rank")
    top = keyword.groupBy("query_id").agg(F.max("score").alias("top"))
    whole = F.when(F.col("top") != 0, F.col("top")).otherwise(F.lit(1.0))
    k = keyword.join(top, "query_id").groupBy("query_id", "doc").agg(F.sum(F.col("score") / whole * keyword_weight).alias("k"), F.min("rank").alias("k_rank"))
    both = v.join(k, ["query_id", "doc"], "full").withColumn("score", F.round(F.coalesce("v", F.lit(0.0)) + F.coalesce("k", F.lit(0.0)), 6))
    return _with_rank(both, F.col("score").desc(), F.col("v_rank").asc_nulls_last(), F.col("k_rank").asc_nulls_last()).select("query_id", "doc", "score", "rank")
