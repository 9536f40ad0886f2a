"""First occurrences of many strings in long texts, of which no task holds more than a block.

A string of n characters is known by its size and by the hashes of its first and its last 2^k characters, with the largest 2^k
up to n. A text is read in blocks; the hashes of its windows of 2^k characters are made from those of half as many, for all
positions at once. What agrees in both hashes is taken for an occurrence if its SHA-256 agrees too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpuslake.operators.common import bounded, materialize, wide

#: Characters of a text that are looked into at once, and of the longest string that is looked for at once: longer ones are parted.
BLOCK, LONGEST = 1 << 17, 1 << 14
#: Characters of a text that one task reads, at most and at least; the strings looked for in the text go to each of them.
STRETCH, SHORT_STRETCH = 64 << 20, 1 << 20
#: Strings that are sent as one row, on average.
TOGETHER = 4_096
MARK = 16
#: Pairs of positions and strings that are compared at once.
PAIRS = 1 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mark(text: Column) -> Column:
    """What a string is known by: the first bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, MARK)


def _mark(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:MARK]


def _mixed(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    spare = np.empty_like(x) if spare is None else spare[: len(x)]
    x ^= np.right_shift(x, np.uint64(32), out=spare)
    x *= _B
    x ^= np.right_shift(x, np.uint64(29), out=spare)
    return x


def _windows(text: str, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, the hashes of all windows of 2^k characters) up to k = top; an array is used anew for k + 2."""
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    other, spare = np.empty_like(h), np.empty_like(h)
    h += np.uint64(1)
    h *= _A
    yield 0, _mixed(h, spare)
    for k in range(1, top + 1):
        half = 1 << (k - 1)
        if len(h) <= half:
            return
        x = np.multiply(h[:-half], _A, out=other[: len(h) - half])
        x += h[half:]
        h, other = _mixed(x, spare), h
        yield k, h


def _level(sizes: np.ndarray) -> np.ndarray:
    return np.frexp(sizes)[1] - 1


def _ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and the last 2^k characters of each text; none is empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins, level = np.cumsum(sizes) - sizes, _level(sizes)
    head, tail = np.empty(len(texts), np.uint64), np.empty(len(texts), np.uint64)
    for k, h in _windows("".join(texts), int(level.max())):
        mine = np.flatnonzero(level == k)
        head[mine] = h[begins[mine]]
        tail[mine] = h[begins[mine] + sizes[mine] - (1 << k)]
    return head, tail


def _parts(text: str, longest: int) -> list[tuple[int, str]]:
    """(begin, part) that cover the text; the last one may overlap the one before."""
    if len(text) <= longest:
        return [(0, text)]
    return [(b, text[b : b + longest]) for b in (*range(0, len(text) - longest, longest), len(text) - longest)]


class _Wanted:
    """The strings of one or more units, found by their hashes; those of unit i only in the text of unit i."""

    def __init__(self, units: list[list[pa.StructArray]]):
        columns = [s.flatten() for u in units for s in u]
        join = lambda i, kind: np.concatenate([c[i].to_numpy(zero_copy_only=False) for c in columns]).astype(kind)
        self.marks = b"".join(x for c in columns for x in c[0].to_pylist())
        self.size, self.every = join(1, np.int64), join(4, bool)
        head, self.tail = join(2, np.int64).view(np.uint64), join(3, np.int64).view(np.uint64)
        self.salts = _mixed(np.arange(len(units), dtype=np.uint64) * _A)
        counts = [sum(map(len, u)) for u in units]
        head = head ^ np.repeat(self.salts, counts)
        self.found = np.zeros(len(head), bool)
        self.levels = {}
        level = _level(self.size)
        for k in np.unique(level).tolist():
            entries = np.flatnonzero(level == k)
            entries = entries[np.argsort(head[entries], kind="stable")]
            shift = np.uint64(64 - min(len(entries).bit_length() + 4, 26))
            seen = np.zeros(1 << (64 - int(shift)), bool)
            seen[head[entries] >> shift] = True
            self.levels[k] = head[entries], entries, seen, shift

    def scan(self, texts: list[str], owned: int) -> Iterator[tuple[int, int, bytes]]:
        """(unit, position in its text, mark): the first occurrence of each string that wasn't found before, all of those marked so, that begin before `owned`."""
        text, lengths = "".join(texts), np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        salts = np.repeat(self.salts, lengths) if len(texts) > 1 else None  # that of a single unit is 0
        slots = np.empty(len(text), np.uint64)
        for k, h in _windows(text, max(self.levels)):
            if k not in self.levels:
                continue
            heads, entries, seen, shift = self.levels[k]
            windows = h
            h, salt = h[:owned], None if salts is None else salts[: min(len(h), owned)]
            keys = np.right_shift(h if salt is None else h ^ salt, shift, out=slots[: len(h)])
            at = np.flatnonzero(seen.take(keys.view(np.int64), mode="clip"))
            keys = h[at] if salt is None else h[at] ^ salt[at]
            low = np.searchsorted(heads, keys)
            count = np.searchsorted(heads, keys, "right") - low
            at, low, count = (x[count > 0] for x in (at, low, count))
            upto = np.cumsum(count)
            begin = 0
            while begin < len(at):
                end = max(int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS)), begin + 1)
                n = count[begin:end]
                place = np.repeat(at[begin:end], n)
                e = entries[np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                begin = end
                unit = np.searchsorted(begins, place, "right") - 1
                last = place + self.size[e]
                fits = (last <= ends[unit]) & (self.every[e] | ~self.found[e])
                place, e, unit, last = (x[fits] for x in (place, e, unit, last))
                same = windows[last - (1 << k)] == self.tail[e]
                place, e, unit = place[same], e[same], unit[same]
                for i in self._checked(text, place, e):
                    yield int(unit[i]), int(place[i] - begins[unit[i]]), self._mark_of(int(e[i]))

    def _mark_of(self, e: int) -> bytes:
        return self.marks[e * MARK : (e + 1) * MARK]

    def _checked(self, text: str, place: np.ndarray, e: np.ndarray) -> Iterator[int]:
        """Which of the places, in ascending order, hold their string: the first of each string, or every one."""
        left = np.arange(len(place))
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(e[left], return_index=True)[1]] = True
            first |= self.every[e[left]]
            for i in left[first].tolist():
                x = int(e[i])
                if _mark(text[int(place[i]) : int(place[i]) + int(self.size[x])]) == self._mark_of(x):
                    self.found[x] = True
                    yield i
            left = left[~first]
            left = left[~self.found[e[left]]]  # after a place that agreed in its hashes only


class _Unit:
    """A stretch of one document's text, given in order, and the strings that are looked for in it."""

    def __init__(self, key: tuple):
        self.key, self.strings, self.held, self.length, self.base = key, [], [], 0, 0
        self.wanted: _Wanted | None = None

    def add(self, at: int, text: str) -> None:
        if not self.held:
            self.base = at
        text = text[max(self.base + self.length - at, 0) :]  # a row that is there twice
        self.held.append(text)
        self.length += len(text)

    def full_blocks(self, block: int, longest: int) -> Iterator[tuple]:
        text, at = "".join(self.held), 0
        while len(text) - at >= block + longest:
            yield from self._scan(text[at : at + block + longest], at, block)
            at += block
        self.held, self.length, self.base = [text[at:]], len(text) - at, self.base + at

    def rest(self) -> Iterator[tuple]:
        yield from self._scan("".join(self.held), 0, self.length)

    def _scan(self, text: str, offset: int, owned: int) -> Iterator[tuple]:
        self.wanted = self.wanted or _Wanted([self.strings])
        for _, at, m in self.wanted.scan([text], owned):
            yield self.key[0], m, self.base + offset + at


def _together(units: list[_Unit]) -> Iterator[tuple]:
    """Short texts are looked into at once, each for its own strings."""
    if units:
        texts = ["".join(u.held) for u in units]
        for i, at, m in _Wanted([u.strings for u in units]).scan(texts, sum(map(len, texts))):
            yield units[i].key[0], m, units[i].base + at


def _look(batches: Iterator[pa.RecordBatch], block: int = BLOCK, longest: int = LONGEST) -> Iterator[pa.RecordBatch]:
    """(doc, part, at) of rows (doc, _group, at, text, strings) in order: a stretch's strings, without a text, come before its text."""
    unit, short, chars, kind = None, [], 0, None

    def given(hits: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(hits, 10_000)):
            docs, marks, ats = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(marks, pa.binary()), pa.array(ats, pa.int64())], ["doc", "part", "at"])

    for b in batches:
        kind, strings = b.schema.field(0).type, b.column(4)
        for i, (doc, group, at, text) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)))):
            if unit is None or unit.key != (doc, group):
                if unit is not None and unit.wanted:
                    yield from given(unit.rest())
                elif unit is not None and unit.strings and unit.length:
                    short.append(unit)
                    chars += unit.length
                    if chars >= block:
                        yield from given(_together(short))
                        short, chars = [], 0
                unit = _Unit((doc, group))
            if text is None:
                unit.strings.append(strings[i].values)
            elif unit.strings:
                unit.add(at, text)
                if unit.length >= block + longest:
                    yield from given(unit.full_blocks(block, longest))
    if unit is not None and unit.wanted:
        yield from given(unit.rest())
    elif unit is not None and unit.strings and unit.length:
        short.append(unit)
    yield from given(_together(short))


def _described(batches: Iterator[pa.RecordBatch], block: int = BLOCK, longest: int = LONGEST) -> Iterator[pa.RecordBatch]:
    """(doc, mark, size, begin, parts, part, part_size, head, tail) of each part of each string (doc, mark, text)."""
    names = ["doc", "mark", "size", "begin", "parts", "part", "part_size", "head", "tail"]

    def described(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        *first, texts = zip(*rows)
        head, tail = _ends(list(texts))
        types = [kind, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [*(pa.array(x, t) for x, t in zip(first, types)), pa.array([len(t) for t in texts], pa.int64()), pa.array(head.view(np.int64)), pa.array(tail.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names)

    for b in batches:
        rows, chars = [], 0
        for doc, m, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            parts = _parts(text, longest)
            for begin, part in parts:
                rows.append((doc, m, len(text), begin, len(parts), m if len(parts) == 1 else _mark(part), part))
                chars += len(part)
                if chars >= block:
                    yield described(rows, b.schema.field(0).type)
                    rows, chars = [], 0
        if rows:
            yield described(rows, b.schema.field(0).type)


def first_occurrences(texts: DataFrame, sizes: DataFrame, strings: DataFrame) -> DataFrame:
    """(doc, mark, size, at) of the distinct strings (doc, mark, text) that aren't empty: the position of the first occurrence in their document, or null.

    texts (doc, start, text) are the documents' texts in pieces that follow one another, with their positions; sizes (doc, size)
    are the documents' lengths. A document's text is read in stretches, by as many tasks.
    """
    spark = texts.sparkSession
    doc = strings.schema["doc"].dataType
    described = "mark binary, size bigint, begin bigint, parts bigint, part binary, part_size bigint, head bigint, tail bigint"
    filled = strings.select("doc", "mark", "text").filter(F.length("text") > 0)
    known = bounded(filled).mapInArrow(partial(_described, block=BLOCK, longest=LONGEST), StructType([StructField("doc", doc), *StructType.fromDDL(described).fields])).distinct()
    known = materialize(known, "strings")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    stretch = min(max(total // (8 * spark.sparkContext.defaultParallelism), SHORT_STRETCH), STRETCH)

    bucket = F.pmod(F.xxhash64("part"), F.lit(max(known.count() // TOGETHER, 1)))
    each = known.groupBy("doc", "part", "part_size", "head", "tail").agg((F.max("parts") > 1).alias("every"))
    packed = each.groupBy("doc", bucket.alias("_bucket")).agg(F.collect_list(F.struct("part", "part_size", "head", "tail", "every")).alias("strings"))  # about TOGETHER
    reach = sizes.select(F.col("doc").alias("_doc"), F.greatest(F.floor((F.col("size") - 1) / stretch), F.lit(0)).cast("long").alias("_last"))
    asked = packed.join(reach, F.col("doc").eqNullSafe(F.col("_doc"))).select(
        "doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_group"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("text"), "strings"
    )
    # a stretch goes on over the longest string that may begin in it
    end = F.col("start") + F.length("text")
    in_stretches = F.sequence(F.greatest(F.floor((F.col("start") - LONGEST) / stretch), F.lit(0)).cast("long"), F.floor((end - 1) / stretch).cast("long"))
    cut = texts.filter(F.length("text") > 0).select("doc", "start", "text", end.alias("_end"), F.explode(in_stretches).alias("_group"))
    low, high = F.greatest("start", F.col("_group") * stretch), F.least("_end", (F.col("_group") + 1) * stretch + LONGEST)
    cut = cut.withColumn("_low", low).withColumn("_high", high).filter("_low < _high")
    whole = (F.col("_low") == F.col("start")) & (F.col("_high") == F.col("_end"))
    piece = F.when(whole, F.col("text")).otherwise(F.substring("text", (F.col("_low") - F.col("start") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")))
    pieces = cut.select("doc", "_group", F.col("_low").alias("at"), piece.alias("text"), F.lit(None).cast(asked.schema["strings"].dataType).alias("strings"))

    rows = asked.unionByName(pieces).repartition(wide(spark), "doc", "_group").sortWithinPartitions("doc", "_group", "at")
    schema = StructType([StructField("doc", doc), *StructType.fromDDL("part binary, at bigint").fields])
    hits = materialize(bounded(rows).mapInArrow(partial(_look, block=BLOCK, longest=LONGEST), schema), "occurrences")

    found = hits.select(F.col("doc").alias("_doc"), F.col("part").alias("_part"), "at")
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part"))
    short = known.filter("parts = 1").join(found.groupBy("_doc", "_part").agg(F.min("at").alias("at")), same).select("doc", "mark", "at")
    begun = known.filter("parts > 1").join(found, same).withColumn("at", F.col("at") - F.col("begin")).filter("at >= 0")
    whole = begun.groupBy("doc", "mark", "parts", "at").agg(F.count_distinct("begin").alias("n")).filter("n = parts")
    placed = short.unionByName(whole.groupBy("doc", "mark").agg(F.min("at").alias("at")))
    placed = placed.select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "at")
    keys = known.filter("begin = 0").select("doc", "mark", "size")
    return keys.join(placed, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").select("doc", "mark", "size", "at")
