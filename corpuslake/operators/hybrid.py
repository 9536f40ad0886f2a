"""Hybrid retrieval: BM25 and vectors, fusion, result dedup, threshold and backfill, for all queries in one plan."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions.strings import strip
from corpuslake.operators import bm25, fusion, vector
from corpuslake.operators.common import materialize, small

CONFIG = EngineConfig()
PREFIX = 80


def ordinals_of_hits(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits (query_id, document, score, rank) with doc: the smallest ordinal of an equal text, -1 if there is none."""
    first = docs.groupBy("document").agg(F.min("doc").alias("doc"))
    return hits.join(first, "document", "left").select("query_id", F.coalesce("doc", F.lit(-1)).cast("long").alias("doc"), "score", "rank")


def dedup_results(hits: DataFrame, source: str = "source") -> DataFrame:
    """Drops repeated texts, and near repeats across sources, from hits (query_id, document, source, score, rank, ...).

    A text whose first PREFIX characters, stripped, equal those of the latest kept hit with that prefix is dropped
    unless both have the same known source; if its score is higher it takes that hit's place. The rule depends on
    what is kept so far, so each query's hits (a candidate pool, bounded by top_k) are folded in rank order.
    """
    prefixed = hits.withColumn("_prefix", strip(F.substring(F.coalesce("document", F.lit("")), 1, PREFIX)))

    def fold(pool: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        texts: set = set()
        latest: dict[str, int] = {}
        pool = pool.sort_values("rank").reset_index(drop=True)
        for i, (text, prefix, origin, score) in enumerate(zip(pool["document"], pool["_prefix"], pool[source], pool["score"])):
            if text in texts:
                continue
            place = latest.get(prefix) if prefix else None
            if place is not None:
                holder = pool.iloc[kept[place]]
                if not (origin and holder[source] and origin == holder[source]):
                    if score > holder["score"]:
                        kept[place] = i
                    continue
            texts.add(text)
            if prefix:
                latest[prefix] = len(kept)
            kept.append(i)
        out = pool.iloc[kept].drop(columns="_prefix")
        out["rank"] = range(1, len(out) + 1)
        return out

    return prefixed.groupBy("query_id").applyInPandas(fold, hits.schema)


def select_hits(hits: DataFrame, top_k: int, threshold: float = 0.0, backfill: bool = True) -> DataFrame:
    """The first top_k hits that reach the threshold, filled up with the others in their order if backfill."""
    passed = F.col("score") >= threshold
    pool = hits if backfill else hits.filter(passed)
    w = Window.partitionBy("query_id").orderBy(F.when(passed, 0).otherwise(1), "rank")
    return pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def candidates(index: bm25.Index, store: DataFrame, queries: DataFrame, pool: int, method: str = "rrf", where: Column | None = None) -> DataFrame:
    """Fused candidates (query_id, doc, score, rank). store has doc and embedding, queries have query_id, question and vector."""
    keyword = bm25.search(index, queries, pool)
    near = vector.nearest(store, queries, pool, where)
    fuse: Callable[..., DataFrame] = {"rrf": fusion.reciprocal_rank, "linear": fusion.linear}[method]
    return fuse(keyword, near)


def search(index: bm25.Index, store: DataFrame, queries: DataFrame, top_k: int = CONFIG.top_k, method: str = "rrf", threshold: float = 0.0, backfill: bool = True, active_only: bool = False, dedup: bool = True) -> DataFrame:
    """(query_id, doc, document, source, score, rank): store has doc, document, source and embedding."""
    rows = store.filter("is_active") if active_only else store
    fused = materialize(candidates(index, rows, queries, CONFIG.pool(top_k), method), "fused")
    texts = rows.select("doc", "document", "source").join(small(fused.select("doc").distinct()), "doc", "left_semi")  # texts of the pool alone are shuffled
    hits = fused.join(texts, "doc", "left").select("query_id", "doc", F.coalesce("document", F.lit("")).alias("document"), F.coalesce("source", F.lit("")).alias("source"), "score", "rank")
    return select_hits(dedup_results(hits) if dedup else hits, top_k, threshold, backfill)


class HybridRetriever:
    """A store with its index, built once and re-read."""

    def __init__(self, store: DataFrame, path: str | None = None):
        self.store = store
        self.index = bm25.build_index(store.select("doc", "document"), written=True)
        if path:
            self.index.write(path)
            self.index = bm25.Index.read(store.sparkSession, path)

    def search(self, queries: DataFrame, **options) -> DataFrame:
        return search(self.index, self.store, queries, **options)


def hybrid_search(store: DataFrame, queries: DataFrame, **options) -> DataFrame:
    return HybridRetriever(store).search(queries, **options)


__all__ = ["HybridRetriever", "candidates", "dedup_results", "hybrid_search", "ordinals_of_hits", "search", "select_hits"]
