"""A prefix trie of conversations: which openings they share, and what sharing them saves.

Only a 16-byte digest and the length of each turn go beyond the first scan. Turns are sorted by range, so that a
conversation of any length lies in as many tasks as it needs, and packed into segments of at most `SEGMENT` turns. A
prefix is known by its state: the sum, in four lanes of 32 bits, of a mix of each turn's digest with its place. States
add up, so segments give them apart. Equal conversations (same length and state) become one class before the trie is built;
its members' ids are sorted by range, written as text in parts, and hashed part by part.

Classes are partitioned by the digest of their first turn. Those first turns with at most `limit` turns below them are
dealt to buckets by hash, and applyInPandas builds their tries: a dictionary from (node, digest) to the child, pointers
to first child, next sibling and parent, and an iterative postorder for what subtrees sum up. First turns with more are
partitioned again by the following turn, then by the second after that, the fourth and so on, so that the rounds grow with the
logarithm of the depth; the levels that this passes (the spine) are summed by Spark: a node's sums belong to its
smallest member, a suffix sum along each class's path gives what its nodes at or below each depth hold, and a node adds these up over
the classes that pass it.

Null roles and texts are empty; rows with a null conv_id belong to no conversation and are left out; turns of equal
number (nulls are first, and equal) stand in the order of the MD5 of the role's length, a colon, role and text, so repeated
rows are turns of their own; c - c%100 takes the remainder's sign from c. A conversation without rebuilt turns ends
at the root. An empty table has no root and gives an empty result; texts of any length are only measured and hashed;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import BROADCAST_KEYS, discard, materialize, small_batches, wide

#: Turns of a packed row.
SEGMENT = 1024
#: Turns (of distinct conversations) that one first turn, or one of its later parts, may have in a task.
LIMIT = 50_000
#: Turns that a bucket of first turns gets on average, at most.
BUCKET = 25_000
#: Conversations of a sharing group: each takes its opening from the first of them.
GROUP = 100
#: Openings have fewer turns than this.
OPENINGS = 6
#: Ids of a part of a class's list.
PART_IDS = 50_000
#: Depths of a block of a suffix sum.
BLOCK = 4096

NONE = hashlib.sha256(b"").hexdigest()
ROOT = bytes(16)
LANES = [f"s{j}" for j in range(4)]
LOW = 0xFFFFFFFF


# ---------------------------------------------------------------- states


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lanes(keys: bytes, start: int) -> np.ndarray:
    """For each turn (16 bytes of keys), which stands at start and so on, four numbers of 32 bits."""
    halves = np.frombuffer(keys, "<u8").reshape(-1, 2)
    place = mixed(np.arange(start + 1, start + 1 + len(halves), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(halves), 4), np.uint64)
    for j in range(4):
        turned = halves[:, 1] if not j else (halves[:, 1] << np.uint64(16 * j)) | (halves[:, 1] >> np.uint64(64 - 16 * j))
        out[:, j] = mixed(mixed(halves[:, 0] ^ place) + turned) >> np.uint64(32)
    return out


def states(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The states before each turn and after the last, as rows of four 32-bit numbers."""
    return ((np.vstack([np.zeros((1, 4), np.uint64), np.cumsum(own, axis=0, dtype=np.uint64)]) + before) & np.uint64(LOW)).astype("<u4")


# ---------------------------------------------------------------- turns and openings


def packed_turns(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, start, n, keys, lens): runs of a conversation's turns in order; start counts from 0."""
    spark = conversations.sparkSession
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", key.alias("key"), F.char_length(text).alias("len"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, local, rows = TaskContext.get().partitionId(), None, 0, []
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            keys, lens = b"".join(b.column(1).to_pylist()), b.column(2).to_numpy(zero_copy_only=False).astype("<i4")
            begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else []
            for a, z in zip(begins, [*begins[1:], len(ids)]):
                if ids[a] != conv:
                    conv, local = ids[a], 0
                for i in range(int(a), int(z), segment):
                    e = min(i + segment, int(z))
                    rows.append((int(conv), part, local, e - i, keys[16 * i : 16 * e], lens[i:e].tobytes()))
                    local += e - i
            if rows:
                yield arrow(rows, RUNS)
                rows = []

    sorted_turns = turns.repartitionByRange(wide(spark), *order).sortWithinPartitions(*order).select("conv_id", "key", "len")
    runs = materialize(sorted_turns.mapInArrow(run, RUNS), "turns")
    per = runs.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    later = per.select("conv_id", "part", F.sum("n").over(before).alias("passed")).filter("passed IS NOT NULL")
    later = F.broadcast(later)  # a range partition goes on with one conversation at most: fewer rows than partitions
    return runs.join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("local") + F.coalesce("passed", F.lit(0))).alias("start"), "n", "keys", "lens")


RUNS = "conv_id bigint, part int, local bigint, n int, keys binary, lens binary"


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [name for name, _ in fields])


REBUILT = "conv_id bigint, start bigint, n int, keys binary, lens binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint, first binary"


def rebuilt(turns: DataFrame) -> DataFrame:
    """The runs of the rebuilt conversations with the lanes' sums of each, and the first turn's state where a run has it.

    Each conversation has a run that starts at 0, perhaps an empty one.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENINGS).cast("int")
    opening = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("start") < OPENINGS - 1))
    joined = F.sort_array(F.collect_list(F.struct("start", "keys", "lens")))  # as many rows as an opening has turns, at most

    def glued(part: str, size: int) -> Column:
        return F.substring(F.aggregate("r", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x[part])), 1, size * (OPENINGS - 1))

    opening = opening.groupBy(F.col("conv_id").alias("base")).agg(joined.alias("r")).select("base", glued("keys", 16).alias("head_keys"), glued("lens", 4).alias("head_lens"))
    ids = turns.filter("start = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = ids.join(opening, "base", "left").select("conv_id", "h", "head_keys", "head_lens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, start, keys, lens, take, head_keys, head_lens in zip(*(c.to_pylist() for c in b.columns)):
                head_keys, head_lens = (head_keys or b"")[: 16 * take], (head_lens or b"")[: 4 * take]
                cut = max(0, take - start)
                keys, lens = keys[16 * cut :], lens[4 * cut :]
                at = max(start, take) - take + len(head_keys) // 16
                if not start:
                    keys, lens, at = head_keys + keys, head_lens + lens, 0
                if keys or not start:
                    own = lanes(keys, at)
                    first = own[0].astype("<u4").tobytes() if keys and not at else None
                    rows.append((conv, at, len(keys) // 16, keys, lens, *(int(x) & LOW for x in own.sum(axis=0, dtype=np.uint64)), first))
            if rows:
                yield arrow(rows, REBUILT)

    beside = turns.join(heads, "conv_id").select("conv_id", "start", "keys", "lens", "h", "head_keys", "head_lens")
    return beside.mapInArrow(run, REBUILT)


# ---------------------------------------------------------------- classes of equal conversations

CLASS = ["f0", "f1", "f2", "f3", "length"]
PARTS = "f0 bigint, f1 bigint, f2 bigint, f3 bigint, length bigint, first_id bigint, n bigint, listed binary"
CLASSES = "length bigint, conv_id bigint, members bigint, ends string"


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def classes(runs: DataFrame) -> DataFrame:
    """(conv_id, length, members, ends) of each class of equal conversations: its smallest id, number and listed ids' SHA-256."""
    spark = runs.sparkSession
    whole = runs.groupBy("conv_id").agg(F.sum("n").alias("length"), *(low(F.sum(s)).alias(f) for s, f in zip(LANES, CLASS)))
    order = [*CLASS, "conv_id"]
    whole = materialize(whole, "wholes")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def row() -> tuple:
            return (*at, held[0], len(held), ",".join(map(str, held)).encode())

        for b in batches:
            rows = []
            for *key, conv in zip(*(c.to_pylist() for c in b.columns)):
                if key != at or len(held) >= PART_IDS:
                    if held:
                        rows.append(row())
                    at, held = key, []
                held.append(conv)
            if rows:
                yield arrow(rows, PARTS)
        if held:
            yield arrow([row()], PARTS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = found = None
        for b in batches:
            rows = []
            for row in range(b.num_rows):
                *key, first, n, listed = (b.column(i)[row].as_py() for i in range(b.num_columns))
                if key != at:
                    if at:
                        rows.append((at[4], found[0], found[1], found[2].hexdigest()))
                    at, found = key, [first, 0, hashlib.sha256()]
                found[2].update(b"," * bool(found[1]) + listed)
                found[1] += n
            if rows:
                yield arrow(rows, CLASSES)
        if at:
            yield arrow([(at[4], found[0], found[1], found[2].hexdigest())], CLASSES)

    n = wide(spark)
    listed = whole.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(parts, PARTS)
    return materialize(listed.repartition(n, *CLASS).sortWithinPartitions(*CLASS, "first_id").mapInArrow(hashed, CLASSES), "classes"), whole


def class_runs(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """The runs of each class's smallest conversation with turns, with the state before each run and the state after the first turn (unit)."""
    kept = materialize(runs.join(kinds.filter("length > 0"), "conv_id").filter("n > 0"), "class-runs")
    before = Window.partitionBy("conv_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    split = kept.filter(F.col("length") > F.col("n")).select("conv_id", "start", "first", *LANES)  # a few numbers a run, of conversations of several runs only
    passed = split.select("conv_id", "start", *(low(F.sum(s).over(before)).alias(f"b{s}") for s in LANES), F.first("first", ignorenulls=True).over(before).alias("unit")).filter("start > 0")
    whole = kept.filter("start = 0").select("*", *(F.lit(0).cast("long").alias(f"b{s}") for s in LANES), F.col("first").alias("unit"))
    return whole.unionByName(kept.filter("start > 0").join(passed, ["conv_id", "start"])).select(*OPEN_COLUMNS[:-2], F.lit(1).cast("long").alias("top"), F.lit(ROOT).alias("above"))


OPEN = "conv_id bigint, start bigint, n int, keys binary, lens binary, bs0 bigint, bs1 bigint, bs2 bigint, bs3 bigint, length bigint, members bigint, ends string, unit binary, top bigint, above binary"
OPEN_COLUMNS = [f.split(" ")[0] for f in OPEN.split(", ")]


# ---------------------------------------------------------------- tries of a bucket

NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, unit binary, above binary"
NODE_COLUMNS = [f.split(" ")[0] for f in NODES.split(", ")]


def build(runs: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of some units; a unit's top has the keys unit and above, and no parent yet."""
    child: dict[tuple[int, bytes], int] = {}
    parent, depth, conv, size, n_convs, ends = [], [], [], [], [], []
    tops: dict[int, tuple[bytes, bytes]] = {}
    at, node = None, -1
    runs = runs.sort_values(["conv_id", "start"])  # a node's first visitor is its smallest member
    for c, start, n, keys, lens, length, members, listed, unit, top, above in zip(*(runs[x].tolist() for x in ("conv_id", "start", "n", "keys", "lens", "length", "members", "ends", "unit", "top", "above"))):
        if c != at:
            at, node = c, -1
        sizes = np.frombuffer(lens, "<i4").tolist()
        for i in range(n):
            key = (node, keys[16 * i : 16 * i + 16] if node >= 0 else unit)
            found = child.get(key)
            if found is None:
                found = child[key] = len(parent)
                parent.append(node)
                depth.append(start + i + 1)
                conv.append(c)
                size.append(sizes[i])
                n_convs.append(0)
                ends.append(None)
                if node < 0:
                    tops[found] = (unit, above)
            node = found
            n_convs[node] += members
        if start + n == length:
            ends[node] = listed
    count = len(parent)
    first, after, kids = [-1] * count, [-1] * count, [0] * count
    for x in range(count - 1, -1, -1):
        if (p := parent[x]) >= 0:
            after[x], first[p], kids[p] = first[p], x, kids[p] + 1
    leaves, saved = [0] * count, [(n_convs[x] - 1) * size[x] for x in range(count)]
    for top in tops:
        x = top
        while first[x] >= 0:
            x = first[x]
        while True:  # postorder: all below x is done
            if not kids[x]:
                leaves[x] = 1
            if x == top:
                break
            p = parent[x]
            leaves[p] += leaves[x]
            saved[p] += saved[x]
            if after[x] >= 0:
                x = after[x]
                while first[x] >= 0:
                    x = first[x]
            else:
                x = p
    keyed = [tops.get(x, (None, None)) for x in range(count)]
    out = {
        "conv_id": conv, "depth": depth, "parent_conv_id": pd.array([conv[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": n_convs, "n_children": kids,
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": [e or NONE for e in ends], "unit": [k[0] for k in keyed], "above": [k[1] for k in keyed],
    }
    return pd.DataFrame(out, columns=NODE_COLUMNS)


def bucket_nodes(runs: DataFrame, total: int) -> DataFrame:
    """The nodes of units of at most LIMIT turns each, some units in each task."""
    buckets = max(wide(runs.sparkSession), -(-total // BUCKET))
    dealt = runs.withColumn("bucket", F.pmod(F.xxhash64("unit", "top"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(build, NODES)


# ---------------------------------------------------------------- the spine of oversized units

SPINE = "conv_id bigint, depth bigint, node binary, above binary, len bigint, members bigint, ends string"


def spine_rows(runs: DataFrame, step: int) -> DataFrame:
    """A row for each turn of runs at the depths top to top + step - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a, z = max(r["top"] - 1 - r["start"], 0), min(r["top"] - 1 + step - r["start"], r["n"])
                if a >= z:
                    continue
                at = states(np.array([r[f"b{s}"] for s in LANES], np.uint64), lanes(r["keys"], r["start"]))
                sizes = np.frombuffer(r["lens"], "<i4").tolist()
                yield arrow([(r["conv_id"], d := r["start"] + i + 1, at[i + 1].tobytes(), at[i].tobytes(), sizes[i], r["members"], r["ends"] if d == r["length"] else None) for i in range(a, z)], SPINE)

    return runs.mapInArrow(run, SPINE)


def deeper(runs: DataFrame, step: int) -> DataFrame:
    """What lies at or below the depth top + step, in units by the state there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                top, cut = r["top"] + step, r["top"] + step - 1 - r["start"]
                if cut >= r["n"]:
                    continue
                unit = above = None  # known only where the run has the turn itself
                if cut >= 0:
                    at = states(np.array([r[f"b{s}"] for s in LANES], np.uint64), lanes(r["keys"], r["start"]))
                    unit, above = at[cut + 1].tobytes(), at[cut].tobytes()
                    r |= {"start": r["start"] + cut, "n": r["n"] - cut, "keys": r["keys"][16 * cut :], "lens": r["lens"][4 * cut :]} | {f"b{s}": int(x) for s, x in zip(LANES, at[cut])}
                rows.append(tuple((r | {"unit": unit, "above": above, "top": top})[c] for c in OPEN_COLUMNS))
            if rows:
                yield arrow(rows, OPEN)

    cut = materialize(runs.mapInArrow(run, OPEN), "cut")
    known = cut.filter("unit IS NOT NULL")
    later = cut.filter("unit IS NULL").drop("unit", "above").join(known.select("conv_id", "unit", "above"), "conv_id")
    return known.unionByName(later)


def within(runs: DataFrame, large: DataFrame, few: bool, kind: str) -> DataFrame:
    return runs.join(F.broadcast(large) if few else large, ["unit", "top"], kind)


def unit_nodes(runs: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written nodes of all units' tries, and written spine rows. Oversized units are partitioned again by later turns."""
    found, spine, step = [], [], 1
    while True:
        sizes = materialize(runs.groupBy("unit", "top").agg(F.sum("n").alias("n")), "sizes")
        large = sizes.filter(F.col("n") > limit).select("unit", "top")
        total, n_large = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > limit, 1))).first()
        few = n_large <= BROADCAST_KEYS
        found.append(materialize(bucket_nodes(within(runs, large, few, "left_anti") if n_large else runs, total), "tries"))
        if not n_large:
            discard(sizes)
            return found, spine
        crowded = materialize(within(runs, large, few, "left_semi").select(*OPEN_COLUMNS), "crowded")
        spine.append(materialize(spine_rows(crowded, step), "spine"))
        runs = materialize(deeper(crowded, step), "deeper")
        discard(sizes)
        discard(crowded)
        step *= 2


def spine_nodes(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The spine's nodes with what their subtrees sum up; tops are those of the units below, which count whole."""
    nodes = materialize(
        rows.groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("len").alias("len"), F.min("above").alias("above"), F.max("ends").alias("ends")), "spine-nodes"
    )
    kids = nodes.select("above").unionByName(tops.select("above")).groupBy("above").agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids.withColumnRenamed("above", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "spine-nodes")
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("len")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaves"))
    below = tops.filter(F.col("above") != F.lit(ROOT)).select("conv_id", "depth", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"))
    zero = F.lit(0).cast("long")
    path = rows.select("conv_id", "depth", "node", zero.alias("saved"), zero.alias("leaves"))
    every = path.unionByName(own.unionByName(below).withColumn("node", F.lit(None).cast("binary"))).withColumn("block", F.floor(F.col("depth") / BLOCK))
    # a suffix sum in two levels, as one class may have very many depths
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("depth").desc())  # equal depths count together
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = every.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(after), zero).alias(f"after_{c}") for c in ("saved", "leaves")))
    summed = every.select("conv_id", "block", "node", *(F.sum(c).over(inside).alias(c) for c in ("saved", "leaves"))).filter("node IS NOT NULL")
    per = summed.join(blocks, ["conv_id", "block"]).groupBy("node").agg(*(F.sum(F.col(c) + F.col(f"after_{c}")).alias(c) for c in ("saved", "leaves")))
    joined = nodes.join(per, "node")
    return joined.select("conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"), F.col("node").alias("unit"), "above")


# ---------------------------------------------------------------- the operator


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, segment: int = SEGMENT) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    limit: turns of distinct conversations that one unit may have in a task; beyond, it is partitioned again by later turns.
    segment: turns of a packed row, at most.
    """
    small_batches(conversations)
    runs = materialize(rebuilt(packed_turns(conversations, segment)), "rebuilt")
    kinds, wholes = classes(runs)
    opened = materialize(class_runs(runs, kinds), "open")
    discard(runs)
    discard(wholes)
    found, spine = unit_nodes(opened, limit)
    nodes = found[0]
    for f in found[1:]:
        nodes = nodes.unionByName(f)
    tops = nodes.filter("unit IS NOT NULL")
    if spine:
        rows = spine[0]
        for s in spine[1:]:
            rows = rows.unionByName(s)
        summed = materialize(spine_nodes(rows, tops), "summed")
        tops = tops.unionByName(summed)
    at_one = tops.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    at_root = kinds.agg(F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.max(F.when(F.col("length") == 0, F.col("ends"))).alias("ends")).filter("conv_id IS NOT NULL")
    zero = F.lit(0).cast("long")
    root = at_root.withColumn("_one", F.lit(1)).join(F.broadcast(at_one.withColumn("_one", F.lit(1))), "_one")  # one row each
    root = materialize(
        root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256")), "root"
    )
    parents = root.select(F.lit(ROOT).alias("above"), F.col("conv_id").alias("parent"))
    few = True
    if spine:
        parents = parents.unionByName(summed.select(F.col("unit").alias("above"), F.col("conv_id").alias("parent")))
        few = parents.count() <= BROADCAST_KEYS
    tops = tops.join(F.broadcast(parents) if few else parents, "above").withColumn("parent_conv_id", F.col("parent"))
    columns = NODE_COLUMNS[:-2]
    return nodes.filter("unit IS NULL").select(*columns).unionByName(tops.select(*columns)).unionByName(root.select(*columns))
