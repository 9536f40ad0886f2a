"""Exact cosine search for batches of query vectors, and vector duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslake.functions.vectors import dot, doubles, similarity_score, unit
from corpuslake.operators.bm25 import ranked
from corpuslake.operators.common import bounded, materialize, small


def nearest(store: DataFrame, queries: DataFrame, top_k: int = 5, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, doc, score, rank): the top_k rows of store (doc, embedding) for each of queries (query_id, vector).

    Queries are a stated set, taken against all rows in blocks: each block of queries is sent to the executors,
    which multiply it with their rows by matrix products and keep top_k candidates for each query and batch,
    so that only those are shuffled. Vectors are normalised in double precision. A null vector, one with a null
    element, or one of another length than the query's is never a hit; a query with such a vector has none.
    """
    rows = store.filter(where) if where is not None else store
    asked = queries.filter(whole(F.col("vector"))).select("query_id", unit(doubles(F.col("vector"))).alias("vector"))
    found = None
    for ids, matrix in _query_blocks(asked):
        part = _block_top(rows, ids, matrix, top_k, threshold)
        found = part if found is None else found.unionAll(part)
    if found is None:
        empty = store.sparkSession.createDataFrame([], "query_id bigint, doc bigint, score double")
        return ranked(empty, top_k, F.col("score").desc(), F.col("doc"))
    return ranked(found, top_k, F.col("score").desc(), F.col("doc"))


def whole(vector: Column) -> Column:
    """Whether a vector has elements and none of them is null."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def _query_blocks(queries: DataFrame, size: int = 2_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids and their matrix, a bounded block of vectors of one length at a time."""
    held: dict[int, list] = {}
    for r in queries.toLocalIterator():
        block = held.setdefault(len(r.vector), [])
        block.append((r.query_id, r.vector))
        if len(block) == size:
            yield np.array([i for i, _ in block], np.int64), np.array([v for _, v in block])
            block.clear()
    for block in held.values():
        if block:
            yield np.array([i for i, _ in block], np.int64), np.array([v for _, v in block])


def _block_top(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, top_k: int, threshold: float | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            docs = b.column(0).to_numpy()
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            score = np.clip(_half_up((x / np.where(length > 0, length, 1)) @ q.T), 0.0, 1.0)
            k = min(top_k, len(docs))
            kth = np.partition(score, len(docs) - k, axis=0)[len(docs) - k]
            keep = score >= kth  # ties at the end stay; the final ranking cuts them by id
            if threshold is not None:
                keep &= score >= threshold
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[j]), pa.array(docs[i]), pa.array(score[i, j])], ["query_id", "doc", "score"])

    fitting = rows.filter(whole(F.col("embedding")) & (F.size("embedding") == matrix.shape[1]))
    return fitting.select(F.col("doc").cast("long"), doubles(F.col("embedding"))).mapInArrow(run, "query_id bigint, doc bigint, score double")


def _half_up(x: np.ndarray) -> np.ndarray:
    """Rounded to four places, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10_000 + 0.5), x) / 10_000


def pair_score(a: Column, b: Column) -> Column:
    """The score of one pair of vectors, as an expression."""
    return similarity_score(dot(unit(doubles(a)), unit(doubles(b))))


#: Bounded sample of stored vectors of a length that its cells are made of, lengths (the commonest) that get such a sample,
#: and rows of a side up to which a cell's comparisons are one group.
PIVOTS, LENGTHS, GROUP_ROWS, BLOCK_ROWS = 256, 16, 20_000, 1_000
#: Vectors that are placed into cells at once, and rows of them that are given at once.
PLACED_ROWS = 2_048


def vector_duplicates(batch: DataFrame, store: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(query_id, doc, score): the nearest of the rows of store (doc, embedding) to each of batch (query_id, vector) that reaches the threshold; of ties the smallest doc.

    A distributed join, exact at any size of either side. Of each of the commonest lengths a bounded sample of stored
    vectors parts space into the cells nearest to each; vectors of another length are one cell. A stored row goes to its cell. A vector that scores the threshold lies within a fixed distance, so
    a row of batch goes to the cells whose dividing plane isn't further off. A cell with many rows on a side is parted, and
    the parts are compared by matrix products. Null and odd vectors never match.
    """
    rows = _units(store, "doc", "embedding")
    asked = _units(batch, "query_id", "vector")
    by_length = {n: np.array(v, float) for n, v in _pivots(rows).items()}
    reach = float(np.sqrt(max(2 - 2 * (threshold - 1e-4), 0.0))) + 1e-9  # scores are rounded

    def cells(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if v.shape[1] not in by_length:
            return np.zeros(len(v), np.int64), np.ones((len(v), 1), bool)
        p = by_length[v.shape[1]]
        d = np.maximum(2 - 2 * v @ p.T, 0)
        home = d.argmin(axis=1)
        between = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[home]
        far = (d - d.min(axis=1, keepdims=True)) > 2 * reach * between + 1e-9
        return home, ~far

    def placed(df: DataFrame, replicated: bool) -> DataFrame:
        return bounded(df).mapInArrow(lambda batches: _placed(batches, cells, replicated), "cell bigint, id bigint, v array<double>")

    left, right = materialize(placed(asked, True), "asked"), materialize(placed(rows, False), "stored")

    def compare(_, mine: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(kept):
            kept = kept.sort_values("id")
            docs, y, x = kept["id"].to_numpy(), np.stack(kept["v"].to_numpy()), np.stack(mine["v"].to_numpy())
            for at in range(0, len(x), BLOCK_ROWS):
                best, where = np.full(len(x[at : at + BLOCK_ROWS]), -1.0), np.zeros(len(x[at : at + BLOCK_ROWS]), np.int64)
                for to in range(0, len(y), BLOCK_ROWS):
                    score = np.clip(_half_up(x[at : at + BLOCK_ROWS] @ y[to : to + BLOCK_ROWS].T), 0.0, 1.0)
                    top = score.argmax(axis=1)
                    value = score[np.arange(len(score)), top]
                    better = value > best
                    best[better], where[better] = value[better], docs[to : to + BLOCK_ROWS][top[better]]
                hit = best >= threshold
                out.append(pd.DataFrame({"query_id": mine["id"].to_numpy()[at : at + BLOCK_ROWS][hit], "doc": where[hit], "score": best[hit]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc": [], "score": []})

    met = _met(left, right, compare)
    return ranked(met, 1, F.col("score").desc(), F.col("doc")).select("query_id", "doc", "score")


def _placed(batches: Iterator[pa.RecordBatch], cells: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], replicated: bool) -> Iterator[pa.RecordBatch]:
    """(cell, id, v) of batches (id, v), for each cell near to a vector or its home only. A vector may go to all cells, so few rows are taken at once and few given at once."""
    for b in batches:
        for n, every, v in _by_length(b.slice(at, PLACED_ROWS) for at in range(0, b.num_rows, PLACED_ROWS)):
            home, near = cells(v)
            i, j = np.nonzero(near) if replicated else (np.arange(len(home)), home)
            for at in range(0, len(i), PLACED_ROWS):
                taken = every.take(pa.array(i[at : at + PLACED_ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(j[at : at + PLACED_ROWS].astype(np.int64) + n * PIVOTS), *taken.columns], ["cell", "id", "v"])


def _met(left: DataFrame, right: DataFrame, compare) -> DataFrame:
    """(query_id, doc, score) that compare makes of the rows (cell, id, v) of left and right of each cell; a cell with many rows on a side is parted."""

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias(name))

    split = parts(left, "ask_parts").join(parts(right, "store_parts"), "cell")  # one row a cell
    split = small(materialize(split, "cells"))
    one = left.join(split, "cell").withColumn("ask", F.pmod(F.xxhash64("id"), F.col("ask_parts")).cast("int")).withColumn("stored", F.explode(F.sequence(F.lit(0), F.col("store_parts") - 1)))
    two = right.join(split, "cell").withColumn("stored", F.pmod(F.xxhash64("id"), F.col("store_parts")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)))
    key = ["cell", "ask", "stored"]
    return one.select(*key, "id", "v").groupBy(*key).cogroup(two.select(*key, "id", "v").groupBy(*key)).applyInPandas(compare, "query_id bigint, doc bigint, score double")


@dataclass
class Cells:
    """A store of vectors, written for searches by cells. rows (cell, id, v) are unit vectors, in a folder for each cell; centres
    (cell, size, centre, radius, n) has the middle of each cell of a common length and the widest angle to it."""

    rows: DataFrame
    centres: DataFrame

    @staticmethod
    def write(store: DataFrame, path: str) -> None:
        """Writes store (doc, embedding); the vectors of each of the commonest lengths go to the nearest of a bounded sample of them, those of another length are one cell."""
        units = materialize(_units(store, "doc", "embedding"), "units")
        by_length = {n: np.array(v, float) for n, v in _pivots(units).items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n, part, v in _by_length(batches):
                home, angle = np.zeros(len(v), np.int64), np.full(len(v), np.pi)
                if n in by_length:
                    near = v @ by_length[n].T
                    home = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(v)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(home + n * PIVOTS), *part.columns, pa.array(angle)], ["cell", "id", "v", "angle"])

        placed = materialize(units.mapInArrow(run, "cell bigint, id bigint, v array<double>, angle double"), "placed")
        placed.select("cell", "id", "v").repartitionByRange("cell", "id").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        middles = [(n * PIVOTS + j, n, v.tolist()) for n, sample in by_length.items() for j, v in enumerate(sample)]  # LENGTHS * PIVOTS at most
        middles = F.broadcast(store.sparkSession.createDataFrame(middles, "cell bigint, size int, centre array<double>"))
        sized = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        middles.join(sized, "cell").write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Cells:
        return Cells(spark.read.schema("id bigint, v array<double>, cell bigint").parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres"))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, their vectors as a matrix) of batches (id, v, ...)."""
    for b in batches:
        size = np.array([len(x) for x in b.column(1)], np.int64) if b.num_rows else np.empty(0, np.int64)
        for n in np.unique(size).tolist():
            part = b.filter(pa.array(size == n))
            yield n, part, part.column(1).flatten().to_numpy().reshape(part.num_rows, n)


def nearest_by_cells(cells: Cells, queries: DataFrame, top_k: int = 5, threshold: float | None = None) -> DataFrame:
    """What nearest() returns, (query_id, doc, score, rank), from a written store, with few of its cells read.

    A vector of a cell is no nearer to a query than the angle to the cell's centre less its radius. The cells that this
    bounds highest are compared first, as many as hold top_k vectors; then those whose bound reaches the last of the top_k scores
    they gave. Queries stay a distributed side, and the driver holds the centres only, whose number is bounded.
    """
    found = CellSearch(cells, queries, top_k)
    scores = found.seen.unionAll(found.compared(found.rest))
    return ranked(scores if threshold is None else scores.filter(F.col("score") >= threshold), top_k, F.col("score").desc(), F.col("doc"))


class CellSearch:
    """first and rest: (cell, id, v) of the queries for each cell that they are compared with; seen: what first gave."""

    def __init__(self, cells: Cells, queries: DataFrame, top_k: int):
        self.rows, self.top_k = cells.rows, top_k
        self.centres: dict[int, tuple] = {}
        held = cells.centres.orderBy("size", "cell").collect()  # LENGTHS * PIVOTS at most
        for n in {r["size"] for r in held}:
            mine = [r for r in held if r["size"] == n]
            self.centres[n] = tuple(np.array([r[c] for r in mine]) for c in ("cell", "centre", "radius", "n"))
        asked = materialize(_units(queries, "query_id", "vector"), "asked")
        self.first = materialize(self._picked(asked.withColumn("last", F.lit(None).cast("double")), True), "first")
        self.seen = materialize(self.compared(self.first), "seen")
        last = ranked(self.seen, top_k, F.col("score").desc(), F.col("doc")).filter(F.col("rank") == top_k)
        again = asked.join(last.select(F.col("query_id").alias("id"), F.col("score").alias("last")), "id", "left")
        others = self._picked(again.select("id", "v", "last"), False)
        self.rest = materialize(others.join(self.first.select("cell", "id"), ["cell", "id"], "left_anti"), "rest")

    def _picked(self, asked: DataFrame, first: bool) -> DataFrame:
        centres, top_k = self.centres, self.top_k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n, part, v in _by_length(batches):
                if n in centres:
                    cell, centre, radius, held = centres[n]
                    angle = np.arccos(np.clip(v @ centre.T, -1, 1)) - radius - 1e-6
                    bound = np.clip(np.cos(np.maximum(angle, 0)), 0, 1)
                else:  # one cell, or none
                    cell, held, bound = np.array([n * PIVOTS]), np.zeros(1), np.ones((len(v), 1))
                if first:
                    order = np.argsort(-bound, axis=1, kind="stable")
                    n_before = np.cumsum(held[order], axis=1) - held[order]
                    row, place = np.nonzero(n_before < top_k)
                    column = order[row, place]
                else:
                    last = part.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
                    row, column = np.nonzero(np.isnan(last) | (bound >= last - 1e-4))  # scores are rounded
                for at in range(0, len(row), 10_000):
                    taken = part.take(pa.array(row[at : at + 10_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell[column[at : at + 10_000]].astype(np.int64)), taken.column(0), taken.column(1)], ["cell", "id", "v"])

        return asked.mapInArrow(run, "cell bigint, id bigint, v array<double>")

    def compared(self, picked: DataFrame) -> DataFrame:
        """(query_id, doc, score): the top_k of each cell, or part of one, for each query picked for it."""
        top_k, most = self.top_k, LENGTHS * PIVOTS
        wanted = [r.cell for r in picked.select("cell").distinct().limit(most + 1).collect()]
        rows = self.rows.filter(F.col("cell").isin(wanted)) if len(wanted) <= most else self.rows.join(picked.select("cell").distinct(), "cell", "left_semi")

        def compare(_, mine: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "doc": np.empty(0, np.int64), "score": np.empty(0)})]
            if len(mine) and len(kept):
                kept = kept.sort_values("id")
                docs, y, x, ids = kept["id"].to_numpy(), np.stack(kept["v"].to_numpy()), np.stack(mine["v"].to_numpy()), mine["id"].to_numpy()
                for at in range(0, len(x), BLOCK_ROWS):
                    for to in range(0, len(y), BLOCK_ROWS):
                        score = np.clip(_half_up(x[at : at + BLOCK_ROWS] @ y[to : to + BLOCK_ROWS].T), 0.0, 1.0)
                        best = np.argsort(-score, axis=1, kind="stable")[:, :top_k]  # of ties the smallest id
                        out.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + BLOCK_ROWS], best.shape[1]), "doc": docs[to : to + BLOCK_ROWS][best].ravel(), "score": np.take_along_axis(score, best, axis=1).ravel()}))
            return pd.concat(out)

        return _met(picked, rows, compare)


def _pivots(rows: DataFrame) -> dict[int, list]:
    """PIVOTS vectors, by a hash of their ids, of each of the LENGTHS commonest lengths of rows (id, v): a bounded number."""
    sized = rows.select(F.size("v").alias("n"), "id", "v")
    common = [r.n for r in sized.groupBy("n").count().orderBy(F.desc("count"), "n").limit(LENGTHS).collect()]
    order = Window.partitionBy("n").orderBy(F.xxhash64("id"), "id")  # a limit by group, which Spark applies in each task first
    found: dict[int, list] = {}
    for r in sized.filter(F.col("n").isin(common)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS).collect():
        found.setdefault(r.n, []).append(r.v)
    return found


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): unit vectors of the rows that have a whole one."""
    return df.filter(whole(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), unit(doubles(F.col(vector))).alias("v"))
