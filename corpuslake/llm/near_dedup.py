"""Near-duplicate filtering on sets of five-word shingles, at a similarity (Jaccard) of 0.8 or more.

Candidates come first from SimHash as the query op9 has it: the same fingerprints, met at the anchors of the covering
code, within the same two bits. These are pairs of a similarity near 1 only: at 0.8 the fingerprints of two texts differ in
about ten bits, and no covering code reaches so far. So MinHash adds the rest: BANDS keys a text, each of ROWS minima. A pair of similarity s misses all keys with probability
(1 - s**ROWS)**BANDS, 1.3e-7 at 0.8 and less above. Candidates of both kinds are decided by their whole shingle sets, so what is
linked is of 0.8 or more. Groups are closed transitively.

Texts that share a key are compared in pairs up to CROWD of them. Beyond, each is compared with the first and the
next few only, so that a large group of near copies needs few comparisons a text. A key of very many texts is parted, so
that no task holds them all; the parts' first texts are compared in the same way. Crowded texts that aren't in one
group after that go through an exact prefix-filtered join: shingles are ordered by how many crowded texts have them,
and a pair of 0.8 or more shares one of the n - ceil(0.8 n) + 1 rarest shingles of either. Shingles that only one
text or one group has come first in that order and make no candidates. A pair's first common shingle must leave as many
behind it in both texts as the pair must share (positional filter), so a passage that very many texts share, which is
what crowds a key, makes hardly any candidates either.

Texts with equal sets are one class from the start, so copies cost one row. Null and empty texts are copies of each
other. Of rows of one group that repeat the kept id one stays; of ties the smallest row_key. Texts of any length are
taken whole. Other columns pass unchanged, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import simhash
from corpuslake.llm.common import BROADCAST_KEYS, discard, materialize, row_key, slices, small_batches, wide, without_keys

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a shingle of op9's fingerprint, and the bits that linked fingerprints may differ in.
MARK_SHINGLE, MARK_BITS = 3, 2
BANDS, ROWS = 40, 5
CROWD, NEXT = 48, 4
#: Rows of a key from which it is parted, and the share of rows by which such keys are noticed.
PART, NOTICED = 4_096, 64

_random = np.random.default_rng(20)
FLIP = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
TIMES = _random.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


# ---------------------------------------------------------------- signatures


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One number for each band of a set; an empty set has none."""
    if not len(h):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(h), 256):
        z = h[at : at + 256] ^ FLIP
        z ^= z >> np.uint64(32)
        z *= TIMES
        np.minimum(least, z.min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = simhash.remixed(key ^ row, 1)
    return key.view(np.int64)


def signatures(keyed: DataFrame) -> DataFrame:
    """row_key, doc_id, the digest of the row's shingle set, that set's size, the keys of its bands and the row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2):
                sets = [shingle_set(t.as_py()) for t in part.column(2)]
                digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
                bands = pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))
                marks = pa.array([simhash.majority(simhash.shingle_hashes(t.as_py(), MARK_SHINGLE)) for t in part.column(2)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], digests, pa.array(list(map(len, sets)), pa.int32()), bands, marks], ["row_key", "doc_id", "digest", "n", "bands", "fp"])

    chosen = keyed.select("row_key", F.col("doc_id").cast("long"), "text")
    return chosen.mapInArrow(run, "row_key binary, doc_id bigint, digest binary, n int, bands array<bigint>, fp bigint")


def shingle_sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, hashes) of the wanted classes (row_key, id), from one row of each."""
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                sets = [shingle_set(t.as_py()).view(np.int64) for t in part.column(1)]
                sizes = pa.array(list(map(len, sets)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "hashes"])

    texts = keyed.select("row_key", "text").join(few, "row_key").select("id", "text")
    return texts.mapInArrow(run, "id bigint, n int, hashes array<bigint>").dropDuplicates(["id"])


# ---------------------------------------------------------------- candidates


def by_fingerprint(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of classes whose rows' fingerprints differ in at most MARK_BITS bits, by the anchors of the covering code.

    Classes that have one fingerprint are each paired with the first of them, which stands for all in links to other fingerprints.
    """
    marks = materialize(signed.select("digest", "fp").distinct().join(classes.select("digest", "id"), "digest").select("fp", "id"), "marks")
    first = materialize(marks.groupBy("fp").agg(F.min("id").alias("first")), "first")
    nodes = first.select(F.col("fp").alias("id"), F.array("fp").alias("fps")).repartition(wide(signed.sparkSession), "id")
    links = simhash.anchor_links(simhash.to_anchors(nodes, MARK_BITS, 1), MARK_BITS)
    a, b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_id")) for x in "ab")
    across = links.join(a, "a").join(b, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    within = marks.join(first, "fp").select(F.col("first").alias("a"), F.col("id").alias("b"))
    found = materialize(across.union(within).filter("a <> b").distinct(), "by_fingerprint")
    discard(marks)
    discard(first)
    return found


def in_groups(rows: DataFrame, pairs, schema: str) -> DataFrame:
    """What pairs(columns of one group of rows with one key) returns; the first column is the key, the second orders a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[list[np.ndarray]] = []

        def flush(parts):
            cols = [np.concatenate(x) for x in zip(*parts)]
            bounds = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1], [True])))
            found = [pairs(*(c[i:j] for c in cols)) for i, j in zip(bounds[:-1], bounds[1:]) if j - i > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if held and held[-1][0][-1] == cols[0][-1]:
                held.append(cols)
                continue
            if held or cut:
                yield from flush([*held, [c[:cut] for c in cols]])
            held = [[c[cut:] for c in cols]]
        if held:
            yield from flush(held)

    key, order = rows.columns[:2]
    return rows.repartition(wide(rows.sparkSession), key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def of_size(x: np.ndarray, y: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9


def near_pairs(similarity: float):
    """Pairs (a, b, 0) of a small group; of a crowded one those with the first and the next rows, and its rows as (id, id, band key)."""

    def pairs(group, ids, n, key):
        size = len(ids)
        if size <= CROWD:
            x, y = np.triu_indices(size, 1)
        else:
            at = np.arange(size)
            x = np.concatenate([np.zeros(size, np.int64), *(at[:-k] for k in range(1, NEXT + 1))])
            y = np.concatenate([at, *(at[k:] for k in range(1, NEXT + 1))])
        ok = (ids[x] < ids[y]) & of_size(x, y, n, similarity)
        a, b, crowd = ids[x[ok]], ids[y[ok]], np.zeros(ok.sum(), np.int64)
        if size > CROWD or group[0] != key[0]:  # of a parted key every part is crowded
            return np.concatenate([a, ids]), np.concatenate([b, ids]), np.concatenate([crowd, key])
        return a, b, crowd

    return pairs


def cross_pairs(similarity: float):
    """Pairs (a, b) of rows with one prefix shingle, of different roots, that can reach the similarity if this shingle is the first they share."""

    def pairs(key, ids, n, root, left):
        order = np.argsort(root, kind="stable")
        ids, n, root, left = ids[order], n[order], root[order], left[order]
        end = np.searchsorted(root, root, side="right")
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(ids)):
            m, rest = n[end[i] :], left[end[i] :]
            common = similarity / (1 + similarity) * (n[i] + m)  # what a pair of these sizes must share
            fits = (np.minimum(n[i], m) >= similarity * np.maximum(n[i], m) - 1e-9) & (np.minimum(left[i], rest) >= common - 1e-9)
            other = end[i] + np.flatnonzero(fits)
            a.append(np.full(len(other), ids[i]))
            b.append(ids[other])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    return pairs


def prefix_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """(h, id, n, root, left) of the prefix shingles of (id, n, hashes, root) that rows of other roots have too; left is how many of the row's shingles stand at or behind h in the order."""
    tokens = sets.select("id", "n", "root", F.explode("hashes").alias("h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("c"), F.min("root").alias("one"), F.max("root").alias("other"), F.min("n").alias("least")).filter("one <> other")
    shared = materialize(shared.select("h", "c", "least"), "shared")
    some = tokens.join(shared, "h").groupBy("id", "n", "root").agg(F.sort_array(F.collect_list(F.struct("c", "h", "least"))).alias("tokens"))  # a text bounds its list
    need = F.ceil(F.col("n") * F.lit(similarity) - 1e-9)
    take = F.greatest(F.size("tokens") - need + 1, F.lit(0)).cast("int")  # n - need + 1, less those that come first
    placed = some.select("id", "n", "root", F.size("tokens").alias("m"), F.posexplode(F.slice("tokens", F.lit(1), take)).alias("at", "t"))
    rows = placed.select("t.h", "t.least", "id", "n", "root", (F.col("m") - F.col("at")).alias("left"))
    smallest = F.greatest(F.col("least"), F.lit(similarity) * F.col("n"))  # partner there can be
    return rows.filter(F.col("left") >= F.lit(similarity / (1 + similarity)) * (F.col("n") + smallest) - 1e-9).select("h", "id", "n", "root", "left")


def verified(pairs: DataFrame, keyed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = materialize(classes.join(ends, "id").select("row_key", "id"), "wanted")
    sets = materialize(shingle_sets(keyed, wanted), "sets")
    a, b = (sets.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("hashes").alias(f"{x}_h")) for x in "ab")
    both = F.size(F.array_intersect("a_h", "b_h"))
    found = materialize(pairs.join(a, "a").join(b, "b").filter(both >= similarity * (F.col("a_n") + F.col("b_n") - both) - 1e-9).select("a", "b"), "links")
    discard(wanted)
    discard(sets)
    return found


def parted(rows: DataFrame) -> DataFrame:
    """(group, id, n, key) of rows (key, id, n): a group is a key, or a part of one that very many rows have, or its parts' first rows."""
    noticed = rows.filter(F.pmod(F.xxhash64("id"), F.lit(NOTICED)) == 0).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") * NOTICED > PART)
    hot = materialize(noticed.select("key", F.ceil(F.col("c") * NOTICED / PART).alias("parts")), "hot")
    plain = rows.select(F.col("key").alias("group"), "id", "n", "key")
    if hot.isEmpty():
        return plain
    few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
    dealt = rows.join(few, "key").withColumn("group", F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("parts"))))
    firsts = dealt.groupBy("key", "group").agg(F.min_by("n", "id").alias("n"), F.min("id").alias("id")).select(F.xxhash64("key", F.lit(-1)).alias("group"), "id", "n", "key")
    others = plain.join(few.select("key"), "key", "left_anti").select("group", "id", "n", "key")
    return others.unionByName(dealt.select("group", "id", "n", "key")).unionByName(firsts)


def open_crowd(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of the rows (key, id) whose key has rows of different roots."""
    rooted = materialize(crowded.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "crowded")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("key")
    return materialize(rooted.join(materialize(mixed, "mixed"), "key", "left_semi").select("id", "root").distinct(), "open")


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row_key, doc_id, root, keeper) of each row; keeper is the smallest id of its group of near duplicates (null if it has none)."""
    keyed = small_batches(docs).select(row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
    signed = materialize(signatures(keyed), "signatures")
    first = signed.groupBy("digest").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("doc_id").alias("least"))
    classes = materialize(first.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select(F.explode("bands").alias("key"), "id", "n")
    met = materialize(in_groups(parted(rows), near_pairs(similarity), "a bigint, b bigint, crowd bigint").distinct(), "met")
    marked = by_fingerprint(signed, classes)
    links = verified(marked.union(met.filter("a <> b").select("a", "b")).distinct(), keyed, classes, similarity)
    discard(marked)
    roots = materialize(simhash.components(links), "roots")
    crowded = met.filter("a = b").select(F.col("crowd").alias("key"), F.col("a").alias("id"))
    if not crowded.isEmpty():
        left_open = open_crowd(crowded, roots)
        wanted = materialize(classes.join(left_open, "id").select("row_key", "id"), "wanted")
        sets = materialize(shingle_sets(keyed, wanted).join(left_open, "id"), "sets")
        cross = materialize(in_groups(prefix_rows(sets, similarity), cross_pairs(similarity), "a bigint, b bigint").distinct(), "cross")
        if not cross.isEmpty():
            more = verified(cross.join(links, ["a", "b"], "left_anti"), keyed, classes, similarity)
            roots = materialize(simhash.components(links.union(more)), "roots")
            discard(more)
        for spent in (left_open, wanted, sets, cross):
            discard(spent)
    discard(met)
    discard(links)
    named = materialize(classes.join(roots, classes.id == roots.node, "left").select("digest", "least", F.coalesce("root", "id").alias("root")), "named")
    # both are written, so that a group or a text of very many rows makes a plain join, which Spark can split
    keepers = materialize(named.groupBy("root").agg(F.min("least").alias("keeper")), "keepers")
    by_class = materialize(named.select("digest", "root").join(keepers, "root"), "by_class")
    return signed.select("row_key", "doc_id", "digest").join(by_class, "digest").select("row_key", "doc_id", "root", "keeper")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their group.

    Rows with a null id stay only where their whole group has none. Of rows of a group that repeat the kept id, or of
    those without one, the row of the smallest row_key stays; rows of other groups under that id aren't touched.
    """
    found = materialize(groups(docs, similarity), "groups")
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("root").agg(F.min("row_key").alias("chosen"), F.count("*").alias("n"))
    # only rows of one group that repeat its id or have none make n over 1
    twice = chosen.filter("n > 1").select("root", "chosen")
    stays = F.col("doc_id").eqNullSafe(F.col("keeper"))
    spare = found.filter(stays).join(twice, "root").filter("row_key <> chosen").select("row_key")
    out = without_keys(docs, row_key(docs.doc_id, docs.text), found.filter(~stays).select("row_key").union(spare))
    if twice.isEmpty():
        return out
    return out.dropDuplicates(["doc_id", "text"])
