"""SimHash near-duplicate detection by anchor-point covering.

The first 46 bits of a fingerprint are two words of 23 bits. The perfect binary Golay code [23, 12] covers
each word at radius 3, so pairs of code words are 2**24 anchors that cover the whole space. A fingerprint's
home is the anchor within the covering radius in both words. Fingerprints that differ in at most t bits lie
within radius plus t of each other's homes, with the excess over the radius at most t over both words
together; so each fingerprint is copied to all those anchors, and each anchor compares its rows. No pair
within t bits is missed, and no pair needs a common exact band.

Null and empty texts have the fingerprint zero and link like any other; repeated rows and ties share one
class; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import BROADCAST_KEYS, discard, materialize, small_batches, wide

RADIUS, BITS, CHECKS = 3, 23, 11
GOLAY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEED = 42


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ASCII-lower-cased, whitespace-separated words, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - size + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def remixed(h: np.ndarray, j: int) -> np.ndarray:
    """Another hash from the same shingles; j = 0 is the hash itself."""
    if j == 0:
        return h
    z = h + np.uint64((j * 0x9E3779B97F4A7C15) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have, as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, tables: int = 1, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns (numbers) and fps of each row of docs; fps has one fingerprint of text for each of `tables` independent hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for text in b.column(len(carry)):
                h = shingle_hashes(text.as_py(), size)
                fps.append([majority(remixed(h, j)) for j in range(tables)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(fps, pa.list_(pa.int64()))], [*carry, "fps"])

    chosen = small_batches(docs).select(*(F.col(c).cast("long") for c in carry), "text")
    return chosen.mapInArrow(run, "".join(f"`{c}` bigint, " for c in carry) + "fps array<bigint>")


# ---------------------------------------------------------------- the covering code


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    x = x.copy()
    for i in range(BITS - 1, CHECKS - 1, -1):
        x ^= ((x >> i) & 1) * (GOLAY << (i - CHECKS))
    return x


@lru_cache
def patterns(threshold: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each excess 0..threshold over the radius: the error patterns ordered by syndrome, where each syndrome's begin, and how many."""
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        e = np.array([sum(1 << i for i in c) for w in weights for c in itertools.combinations(range(BITS), w)], np.int64)
        s = syndrome(e)
        count = np.bincount(s, minlength=1 << CHECKS)
        out.append((e[np.argsort(s, kind="stable")], np.concatenate(([0], np.cumsum(count)[:-1])), count))
    return out


def cover(fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row index, anchor, whether the anchors are homes) for every anchor that a row goes to."""
    u = fp.view(np.uint64)
    one, two = (u & np.uint64(2**BITS - 1)).astype(np.int64), ((u >> np.uint64(BITS)) & np.uint64(2**BITS - 1)).astype(np.int64)
    s1, s2 = syndrome(one), syndrome(two)
    table = patterns(threshold)
    for i, j in itertools.product(range(threshold + 1), repeat=2):
        if i + j > threshold:
            continue
        (e1, at1, n1), (e2, at2, n2) = table[i], table[j]
        total = n1[s1] * n2[s2]
        row = np.repeat(np.arange(len(fp)), total)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        per = n2[s2][row]
        c1 = one[row] ^ e1[at1[s1][row] + nth // per]
        c2 = two[row] ^ e2[at2[s2][row] + nth % per]
        yield row, ((c1 >> CHECKS) << (BITS - CHECKS)) | (c2 >> CHECKS), i == j == 0


def to_anchors(classes: DataFrame, threshold: int, tables: int) -> DataFrame:
    """Rows (key, id, fp): key is twice the anchor's number (with the table's), plus 1 unless the anchor is the row's home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            fps = b.column(1).flatten().to_numpy().reshape(-1, tables)
            for at in range(0, len(ids), 2048):
                for j in range(tables):
                    fp = np.ascontiguousarray(fps[at : at + 2048, j])
                    for row, anchor, home in cover(fp, threshold):
                        key = (((j << 24) | anchor) << 1) | (0 if home else 1)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[at : at + 2048][row]), pa.array(fp[row])], ["key", "id", "fp"])

    return classes.select("id", "fps").mapInArrow(run, "key bigint, id bigint, fp bigint")


# ---------------------------------------------------------------- links per anchor


def spanning_links(ids: np.ndarray, fp: np.ndarray, limit: int) -> tuple[list, list]:
    """Breadth-first forest over the rows of one anchor: the links keep what is connected, at most one a row."""
    left, right = [], []
    waiting = np.arange(len(fp))
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(fp[waiting] ^ fp[at]) <= limit
            if near.any():
                found = waiting[near]
                left += [ids[at]] * len(found)
                right += ids[found].tolist()
                front += found.tolist()
                waiting = waiting[~near]
    return left, right


def links_of(key: np.ndarray, ids: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within complete groups of rows ordered by key."""
    anchor = key >> 1
    begin = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    size = np.diff(np.concatenate((begin, [len(key)])))
    homes = np.add.reduceat((key & 1) == 0, begin)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = (size > 1) & (homes > 0) & (size <= 48)
    b, n, h = begin[small], size[small], homes[small]
    for at in range(0, len(b), 20_000):
        bb, nn, hh = b[at : at + 20_000], n[at : at + 20_000], h[at : at + 20_000]
        total = nn * hh
        g = np.repeat(np.arange(len(bb)), total)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(total) - total, total)
        x, y = bb[g] + nth // nn[g], bb[g] + nth % nn[g]
        ok = (ids[x] != ids[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= limit)
        left.append(ids[x[ok]])
        right.append(ids[y[ok]])
    for i in np.flatnonzero((size > 48) & (homes > 0)):
        part = slice(begin[i], begin[i] + size[i])
        a, c = spanning_links(ids[part], fp[part], limit)
        left.append(np.array(a, np.int64))
        right.append(np.array(c, np.int64))
    a, c = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, c), np.maximum(a, c)


def anchor_links(rows: DataFrame, limit: int) -> DataFrame:
    """Distinct links (a, b), a < b, between ids whose fingerprints share an anchor and differ in at most `limit` bits.

    Where an anchor has many rows, its links are a spanning forest and not all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(parts):
            if parts:
                a, b = links_of(*(np.concatenate(x) for x in zip(*parts)), limit)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if not len(cols[0]):
                continue
            anchor = cols[0] >> 1
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
            if held and held[-1][0][-1] >> 1 == anchor[-1]:
                held.append(cols)
                continue
            yield from flush([*held, [c[:cut] for c in cols]] if cut else held)
            held = [[c[cut:] for c in cols]]
        yield from flush(held)

    n = wide(rows.sparkSession)
    placed = rows.repartition(n, F.shiftright("key", 1)).sortWithinPartitions("key")
    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


# ---------------------------------------------------------------- components


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component.

    Alternates large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def towards_min(pairs: DataFrame, few: bool) -> DataFrame:
        """A node of very many pairs must not end up in one task: its least neighbour is broadcast, or written so that Spark can split the join."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        if few:
            least = F.broadcast(least)
        else:
            least = materialize(least, "least")
            spent.append(least)
        return pairs.join(least, "u").withColumn("m", F.least("u", "m"))

    spent: list[DataFrame] = []
    edges = materialize(links.select("a", "b"), "links")
    before = mark(edges)
    for _ in range(most_rounds if before[0] else 0):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        few = before[0] <= BROADCAST_KEYS
        large = towards_min(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = towards_min(large, few)
        small = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select(F.col("u").alias("b"), F.col("m").alias("a")))
        spent.append(edges)
        edges = materialize(small.filter("a <> b").select("a", "b").distinct(), "links")
        while spent:
            discard(spent.pop())
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicate_classes(docs: DataFrame, size: int = 3, threshold: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): components of documents whose fingerprints differ in at most `threshold` bits.

    component_id is the smallest id that can be reached, itself included. Rows with a null id take part, but
    name a component only if it has no other id (then null).
    """
    doc_fp = materialize(fingerprints(docs, size).select("doc_id", F.col("fps")[0].alias("fp")), "fingerprints")
    classes = doc_fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    n = wide(docs.sparkSession)
    nodes = classes.select(F.col("fp").alias("id"), F.array("fp").alias("fps")).repartition(n, "id")
    roots = components(anchor_links(to_anchors(nodes, threshold, 1), threshold))
    named = materialize(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    # both are written, so that a component or a fingerprint of very many rows makes a plain join, which Spark can split
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_fp = materialize(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "by_fp")
    return doc_fp.join(by_fp, "fp").select("doc_id", "fp", "component_id")
