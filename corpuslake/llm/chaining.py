"""Substring deduplication by collinear chaining.

Seeds are the minimizers of each text's k-word shingles, so an exact run of `seed_words + window - 1` words in
two texts shares one at least. A text's first occurrence of each seed is matched only with the first text that has it (the smallest id), which keeps
the matches linear in the input however many texts share a passage. A passage whose parts are first seen in different
texts can escape that, so a second, exact pass follows: of the stretches that these passages leave open and whose
seeds all occur elsewhere, each window of `min_words` words is matched with the first text that has the whole window
(of equal windows in one text, those that don't overlap, and the last). So every exact run of `min_words` words that
an earlier text has is found. A third pass is for fuzzy passages of this kind: seeds that are open still are joined by pairs,
each two of a text with few seeds between them, with the first text that has the pair. A pair that spans a place where texts
with one part meet those with another is first seen where both parts stand together, and a chain grows from it; and all
occurrences of an open seed in a text are matched, not its first alone. The matches of a pair of texts are chained:
a chain's value is its seeds less a cost for the gaps in both texts, and the best predecessor of a seed is a
prefix maximum that a Fenwick tree holds over the positions in the other text. Chains are then aligned word by
word: gaps between seeds by their longest common subsequence, ends by extension while equal words outweigh the others.
Passages of at least `min_words` equal words at `identity` or more are returned, one row each, with where they lie
in the text and in the text that has them first. Of fuzzy passages those are found whose changes leave two common
seeds, and if other texts had these first, a pair of them that no earlier text has; the shares are measured in the tests.

Null texts and texts of fewer than `min_words` words have no passages; a text's own repetitions don't count;
rows that repeat an id, or have none, are told apart by a row number and reported under that id (a null id
comes after all others, so such a row is never the one that keeps a passage before a row with an id); of ties the
place nearest to the text's begin counts; texts of any length are taken whole, a chain's slice of them growing until
its ends lie within; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.common import BROADCAST_KEYS, bitmap_of, discard, few_or_all, materialize, maybe_among, maybe_in, slices, small_batches, wide

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Plan:
    min_words: int = 50
    identity: float = 0.8
    seed_words: int = 5
    #: Shingles of which the least is a seed; at most 15.
    window: int = 8
    seed_value: float = 60.0
    gap_cost: float = 0.03
    least_seeds: int = 2
    #: Characters fetched beyond a chain's ends at first; where an extension needs more, more are fetched.
    margin: int = 300
    #: An extension ends where its score (equal words less differing ones, weighted) falls so far below its best.
    drop: float = 24.0
    #: Equal words that an extension takes in at most.
    most: int = 2**31
    #: A gap that leaves more than so many words unaligned parts a chain.
    loose_words: int = 20
    #: Pairs of open seeds have fewer than so many others between them, and lie within so many words.
    pair_steps: int = 6
    pair_words: int = 60
    #: Open seeds that lie over fewer words than this, like those of a single common line, make no pairs.
    open_words: int = 15

    def __post_init__(self):
        if not 0 < self.window <= 15 or self.min_words < self.seed_words + self.window - 1:
            raise ValueError("a window has 1 to 15 shingles, and its words must fit into a passage of min_words")

    @property
    def toll(self) -> float:
        """How many equal words outweigh a differing one."""
        return self.identity / max(1 - self.identity, 1e-9)


def lower(text: str) -> str:
    """Lower case of the same length."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


# ---------------------------------------------------------------- seeds


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """For each character whether it belongs to words."""
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    table = np.zeros(0x110000, bool)
    for m in WORD.finditer("".join(every)):
        skip = 0x800 if m.start() >= 0xD800 else 0
        table[m.start() + skip : m.end() + skip] = True
        if m.start() < 0xD800 < m.end():
            table[0xD800 : m.end()] = False
            table[0xE000 : m.end() + 0x800] = True
    return table


@lru_cache(maxsize=1)
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, np.uint64(0x9E3779B97F4A7C15)))))


def hashed_words(low: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of a lower-cased text; at most a million characters and a longest word are hashed at once."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word_table()[codes], [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    length = ends - starts
    power = powers(1 << int(length.max()).bit_length())
    h = np.empty(len(starts), np.uint64)
    total = np.cumsum(length)
    bounds = np.unique(np.concatenate((np.searchsorted(total, np.arange(0, total[-1], 1 << 20)), [len(starts)])))
    for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = length[x:y]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        chars = codes[np.repeat(starts[x:y], n) + place].astype(np.uint64) + np.uint64(1)
        h[x:y] = np.add.reduceat(chars * power[place], first)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29)), starts, ends


#: A reach of so many characters or more isn't kept exactly in a place.
FAR = 2**14 - 1


def seeds(texts: list[str | None], plan: Plan) -> list[np.ndarray]:
    """(hash, which text, character offset, place) of the texts' minimizers, for all at once; texts that are too short have none.

    place packs the first window that the minimizer is the least shingle of, how many there are, and how many
    characters these windows reach before the offset and behind it. The windows of one follow those of the last without
    a gap.
    """
    k, w, least_words = plan.seed_words, plan.window, max(plan.min_words, plan.seed_words)
    lows = [lower(t) if len(t or "") >= 2 * least_words - 1 else "" for t in texts]
    begins = np.cumsum([0, *(len(t) + 1 for t in lows[:-1])])
    words, starts, ends = hashed_words("\n".join(lows))  # no word holds a line feed
    of = np.searchsorted(begins, starts, side="right") - 1
    enough = (np.bincount(of, minlength=len(texts)) >= least_words)[of]
    words, starts, ends, of = words[enough], starts[enough], ends[enough], of[enough]
    if not len(words):
        return [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)]
    n = len(words) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += words[j : j + n] * np.uint64((2 * j + 3) ** 25 % 2**64)
    grams = (grams ^ (grams >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    grams ^= grams >> np.uint64(29)
    m = n - w + 1
    low, least = grams[:m].copy(), np.arange(m)
    for j in range(1, w):  # of equal shingles the first
        less = grams[j : j + m] < low
        low[less] = grams[j : j + m][less]
        least[less] = np.flatnonzero(less) + j
    window = np.flatnonzero(of[:m] == of[k + w - 2 :])  # those within one text
    least = least[window]
    turn = np.flatnonzero(np.concatenate(([True], np.diff(least) != 0)))
    at, first, count = least[turn], window[turn], np.diff(np.append(turn, len(least)))
    h, text = grams[at].view(np.int64), of[at]
    before = np.minimum(starts[at] - starts[first], FAR)
    behind = np.minimum(ends[first + count + k + w - 3] - starts[at], FAR)
    first = first - np.searchsorted(of, text)
    return [h, text, (starts[at] - begins[text]).astype(np.int32), (first << 32) | (count << 28) | (before << 14) | behind]


SEEDS = "h bigint, uid bigint, at int, place bigint, deal int"


def seed_rows(docs: DataFrame, plan: Plan, common: np.ndarray | None = None, parts: int = 1) -> DataFrame:
    """SEEDS rows of all texts; deal is 0, but of a common seed (ascending hashes) it tells the texts apart by so many parts, so that they can be dealt out."""
    common = np.empty(0, np.int64) if common is None else common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEEDS.split(", ")]
        for b in batches:
            for part in slices(b, 1, size=1 << 20):
                h, text, offset, place = seeds(part.column(1).to_pylist(), plan)
                if len(h):
                    uid, deal = part.column(0).to_numpy()[text], np.zeros(len(h), np.int32)
                    if len(common):
                        often = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                        deal[often] = 1 + uid[often] % parts
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, uid, offset, place, deal)], names)

    return docs.select("uid", "text").mapInArrow(run, SEEDS)


#: Of so many texts one is looked at for common seeds.
LOOK = 64


def common_seeds(docs: DataFrame, plan: Plan, parts: int) -> np.ndarray:
    """Ascending hashes of seeds that would be a quarter of a part's rows or more, by the texts that are looked at: four for each part at most.

    They decide how rows are dealt out, and nothing else.
    """
    some = seed_rows(docs.filter(F.pmod(F.xxhash64("uid"), F.lit(LOOK)) == 0), plan)
    counts = materialize(some.groupBy("h").agg(F.count("*").alias("n")), "common")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / (4 * parts)
    found = sorted(r.h for r in counts.filter((F.col("n") >= least) & (F.col("n") > 4)).collect())  # fewer say nothing
    discard(counts)
    return np.array(found, np.int64)


SEED_LIST = "uid bigint, seeds array<struct<at:int,place:bigint,h:bigint,first_uid:bigint,first_at:int,lead:boolean>>"


def seed_lists(repeated: DataFrame) -> DataFrame:
    """SEED_LIST rows of repeated seeds, by their places in the text; a text bounds its list. lead says that a seed is the text's first of its hash; it is made here if repeated doesn't have it."""
    names = re.findall(r"(\w+):", SEED_LIST)
    given = [x for x in names if x in repeated.columns]

    def lists(cols: list[np.ndarray]) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        if len(given) < len(names):
            order = np.lexsort((cols[3], cols[0]))
            h, uid, lead = cols[3][order], cols[0][order], np.ones(len(order), bool)
            lead[order[1:]] = (h[1:] != h[:-1]) | (uid[1:] != uid[:-1])
            cols = [*cols, lead]
        values = pa.StructArray.from_arrays([pa.array(c) for c in cols[1:]], names)
        found = pa.ListArray.from_arrays(pa.array(np.append(begin, len(cols[0])), pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array(cols[0][begin]), found], ["uid", "seeds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_texts(batches):
            order = np.lexsort((cols[1], cols[0]))
            yield lists([c[order] for c in cols])

    n = wide(repeated.sparkSession)
    return repeated.select("uid", *given).repartition(n, "uid").sortWithinPartitions("uid").mapInArrow(run, SEED_LIST)


def repeated_seeds(docs: DataFrame, plan: Plan) -> DataFrame:
    """Written SEED_LIST rows of the seeds that two texts or more have, with the first text (the smallest id) of each and its first place there.

    All of a seed's rows meet in one shuffle. A common seed's are dealt out by texts; its first text is the first of all parts.
    """
    parts = wide(docs.sparkSession)
    common = common_seeds(docs, plan, parts)
    every = Window.partitionBy("h", "deal").orderBy("uid", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = seed_rows(docs, plan, common, parts)
    rows = rows.select("*", F.first("uid").over(every).alias("first_uid"), F.first("at").over(every).alias("first_at"), F.last("uid").over(every).alias("last"))
    if not len(common):
        return materialize(seed_lists(rows.filter("last > first_uid")), "lists")
    written = materialize(rows.filter("deal > 0 OR last > first_uid"), "repeated")
    often = written.filter("deal > 0")
    first = often.groupBy("h").agg(F.min(F.struct(F.col("first_uid").alias("uid"), F.col("first_at").alias("at"))).alias("f"), F.max("last").alias("last")).filter("last > f.uid")
    first = first.select("h", F.col("f.uid").alias("first_uid"), F.col("f.at").alias("first_at"))  # not more than common
    repeated = written.filter("deal = 0").drop("last").unionByName(often.drop("first_uid", "first_at", "last").join(F.broadcast(first), "h"))
    lists = materialize(seed_lists(repeated), "lists")
    discard(written)
    return lists


# ---------------------------------------------------------------- chains


class Fenwick:
    """Prefix maxima of (value, index)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e300, -1)] * (n + 1)

    def put(self, i: int, item: tuple[float, int]) -> None:
        while i < len(self.best):
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        out = (-1e300, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chains(x: np.ndarray, y: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """Disjoint chains of matches (x, y), as index arrays in order, best first; x is ascending."""
    n = len(x)
    near = plan.seed_value / plan.gap_cost
    dx, dy = np.diff(x), np.diff(y)
    if ((dx > 0) & (dy > 0) & (dx + dy < near)).all():
        return [np.arange(n)]
    rank = np.unique(y, return_inverse=True)[1] + 1
    tree = Fenwick(int(rank.max()))
    value, back = [0.0] * n, [-1] * n
    xs, ys, rs = x.tolist(), y.tolist(), rank.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches at one place can't follow each other
            best, at = tree.upto(rs[j] - 1)
            gain = best - plan.gap_cost * (xs[j] + ys[j])
            value[j], back[j] = plan.seed_value + max(gain, 0.0), at if gain > 0 else -1
            j += 1
        for m in range(i, j):
            tree.put(rs[m], (value[m] + plan.gap_cost * (xs[m] + ys[m]), m))
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: (-value[m], m)):
        path, m = [], end
        while m >= 0 and not used[m]:
            path.append(m)
            used[m] = True
            m = back[m]
        if path:
            out.append(np.array(path[::-1]))
    return out


CHAIN = "uid bigint, first_uid bigint, xs array<int>, ys array<int>"


def chain_batch(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, plan: Plan) -> Iterator[pa.RecordBatch]:
    """CHAIN rows of matches, which are in order."""
    if not len(u):
        return
    cut = np.flatnonzero((u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1
    bounds = np.concatenate(([0], cut, [len(u)]))
    enough = np.flatnonzero(np.diff(bounds) >= plan.least_seeds)
    rows = []
    for a, b in zip(bounds[enough].tolist(), bounds[enough + 1].tolist()):
        for c in chains(x[a:b], y[a:b], plan):
            if len(c) >= plan.least_seeds:
                rows.append((u[a], v[a], x[a:b][c], y[a:b][c]))
    if rows:
        c = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(c, kinds)], ["uid", "first_uid", "xs", "ys"])


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The batches' columns, of which the first is ascending, cut so that no value of it is parted."""
    held: list[list[np.ndarray]] = []  # the last text's rows, which may go on
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and held[-1][0][-1] == cols[0][-1]:
            held.append(cols)
            continue
        parts = [*held, [c[:cut] for c in cols]] if cut else held
        if parts:
            yield [np.concatenate(p) for p in zip(*parts)]
        held = [[c[cut:] for c in cols]]
    if held:
        yield [np.concatenate(p) for p in zip(*held)]


def chain_rows(matches: DataFrame, plan: Plan) -> DataFrame:
    """Chains of matches (uid, first_uid, at, first_at), each with its seeds' offsets in both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in whole_texts(batches):
            yield from chain_batch(*cols, plan)

    n = wide(matches.sparkSession)
    placed = matches.select("uid", "first_uid", "at", "first_at").repartition(n, "uid").sortWithinPartitions("uid", "first_uid", "at", "first_at")
    return placed.mapInArrow(run, CHAIN)


def list_chains(lists: DataFrame, plan: Plan) -> DataFrame:
    """Chains of the first occurrences of each text's seeds with the first texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids, found = b.columns
            values = found.flatten()
            at, first, first_at, lead = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5))
            uid = np.repeat(uids.to_numpy(), pc.list_value_length(found).to_numpy(zero_copy_only=False))
            met = np.flatnonzero(lead & (uid > first))
            uid, first, at, first_at = uid[met], first[met], at[met], first_at[met]
            order = np.lexsort((first_at, at, first, uid))
            yield from chain_batch(uid[order], first[order], at[order], first_at[order], plan)

    return lists.mapInArrow(run, CHAIN)


# ---------------------------------------------------------------- alignment


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one bit stands for each word of a."""
    if a == b:
        return len(a)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    every = (1 << len(a)) - 1
    row = every
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


#: How far an extension may step over differing words, and how many equal words must follow; else one word differs.
STEPS = ((1, 1, 2), (1, 0, 4), (0, 1, 4), (2, 1, 4), (1, 2, 4), (2, 0, 4), (0, 2, 4))


#: Words that a walk may look at beyond where it stands, and the last one, which a slice may have cut.
AHEAD = 8
#: Characters beyond a chain's ends that are looked at first, if it has so few seeds; longer ones mostly go on.
NEAR, FEW = 160, 4


def extend(a: list[str], b: list[str], i: int, j: int, step: int, plan: Plan, ahead: tuple[int, int] = (0, 0)) -> tuple[list[tuple[int, int, int, float]], int, bool, bool]:
    """Walks from (i, j) over equal and differing words.

    Returns the ends of its equal runs as (i, j, equal words, score), which of them has the best score, and whether it came to the end of a and of b, or within so many words (ahead) of it.
    """
    if step > 0:
        a, b = a[i:], b[j:]
    else:
        a, b = a[i::-1] if i >= 0 else [], b[j::-1] if j >= 0 else []
    p = q = same = 0
    score, toll = 0.0, plan.toll
    ends, best = [(i, j, 0, 0.0)], 0
    la, lb = len(a), len(b)
    while p < la and q < lb:
        if a[p] == b[q]:
            stop = min(la, p + lb - q, p + plan.most - same)
            while p < stop and a[p] == b[q]:
                p, q, same, score = p + 1, q + 1, same + 1, score + 1
            ends.append((i + step * p, j + step * q, same, score))
            best = len(ends) - 1 if score >= ends[best][3] else best
            if same == plan.most:
                return ends, best, bool(ahead[0]) and p + ahead[0] >= la, bool(ahead[1]) and q + ahead[1] >= lb
            continue
        x = y = 1
        for more, other, need in STEPS:
            u, v = p + more, q + other
            if u + need <= la and v + need <= lb and a[u] == b[v] and a[u : u + need] == b[v : v + need]:
                x, y = more, other
                break
        p, q, score = p + x, q + y, score - toll * max(x, y)
        if score < ends[best][3] - plan.drop:
            return ends, best, bool(ahead[0]) and p + ahead[0] >= la, bool(ahead[1]) and q + ahead[1] >= lb
    return ends, best, p + ahead[0] >= la, q + ahead[1] >= lb


def farthest(ends: list[tuple[int, int, int, float]], best: int, slack: float) -> int:
    return max((m for m in range(best, len(ends)) if ends[best][3] - ends[m][3] <= slack), default=best)


def align(text: str, other: str, xs: list[int], ys: list[int], plan: Plan) -> tuple[list[tuple[int, int, int, int, int, int]], tuple[bool, ...]]:
    """Passages (start, end, other's start, other's end, words, equal words) along a chain, and whether one was stopped by the begin of text, of other, by the end of text, of other; offsets are within the slices.

    Most chains end close by, so what lies near is taken first, and all if an extension comes to where that was cut.
    """
    if text == other and xs == ys:  # copies
        _, starts, ends = hashed_words(lower(text))
        n = len(starts)
        s, e = (int(starts[0]), int(ends[-1])) if n else (0, 0)
        return [(s, e, s, e, n, n)] if n >= plan.min_words else [], (True,) * 4
    c, d = max(xs[0] - NEAR, 0), max(ys[0] - NEAR, 0)
    e, f = xs[-1] + 2 * NEAR, ys[-1] + 2 * NEAR
    cut = (c > 0, d > 0, e < len(text), f < len(other))
    if any(cut) and len(xs) < FEW:
        out, stopped = along(text[c:e], other[d:f], [x - c for x in xs], [y - d for y in ys], plan, tuple(AHEAD * x for x in cut))
        if not any(x and y for x, y in zip(stopped, cut)):
            return [(s + c, t + c, fs + d, ft + d, n, same) for s, t, fs, ft, n, same in out], stopped
    return along(text, other, xs, ys, plan, (0,) * 4)


def words_at(low: str, offsets: list[int]) -> tuple[list[str], list[int]]:
    """The words of a lower-cased text, and which of them begin at the given ascending offsets."""
    words, places, at = [], [], 0
    for x in offsets:
        words += WORD.findall(low, at, x)
        places.append(len(words))
        at = x
    return words + WORD.findall(low, at), places


@lru_cache(maxsize=64)
def other_words(other: str, offsets: tuple[int, ...]) -> tuple[str, list[str], list[int]]:
    """A first text's slice in lower case and its words_at(); rows of one first text come one after another."""
    low = lower(other)
    return low, *words_at(low, offsets)


def along(text: str, other: str, xs: list[int], ys: list[int], plan: Plan, ahead: tuple[int, ...]) -> tuple[list[tuple[int, int, int, int, int, int]], tuple[bool, ...]]:
    """align() of the given slices; stopped also where an extension comes within so many words (ahead) of an end."""
    low, (other_low, b, other_at) = lower(text), other_words(other, tuple(ys))
    a, at = words_at(low, xs)
    k = plan.seed_words
    marks = []
    for i, j in zip(at, other_at):
        if i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k] and (not marks or (i > marks[-1][0] and j > marks[-1][1])):
            marks.append((i, j))
    runs: list[list[list[int]]] = []  # pieces: begin and end in a, begin and end in b, equal words, score of the gap before it, equal words there
    for i, j in marks:
        if runs:
            r = runs[-1][-1]
            if i <= r[1] and i - j == r[1] - r[3]:  # overlaps on the same diagonal
                r[4] += max(i + k - r[1], 0)
                r[1], r[3] = max(r[1], i + k), max(r[3], j + k)
                continue
            if i >= r[1] and j >= r[3]:
                ga, gb = a[r[1] : i], b[r[3] : j]
                if abs(len(ga) - len(gb)) <= plan.loose_words:
                    same = common_words(ga, gb)
                    loose = max(len(ga), len(gb)) - same
                    if loose <= plan.loose_words:
                        runs[-1].append([i, i + k, j, j + k, k, same - plan.toll * loose, same])
                        continue
        runs.append([[i, i + k, j, j + k, k, 0, 0]])
    out, stopped = [], [False] * 4
    while runs:
        r = runs.pop()
        left, lbest, *at_begin = extend(a, b, r[0][0] - 1, r[0][2] - 1, -1, plan, ahead[:2])
        right, rbest, *at_end = extend(a, b, r[-1][1], r[-1][3], 1, plan, ahead[2:])
        stopped = [x or y for x, y in zip(stopped, at_begin + at_end)]
        core = sum(x[4] for x in r) + sum(x[6] for x in r[1:])
        if core + left[lbest][2] + right[rbest][2] < plan.min_words:  # as far as the identity allows
            slack = sum(x[4] for x in r) + sum(x[5] for x in r[1:]) + left[lbest][3] + right[rbest][3]
            far = farthest(right, rbest, slack)
            lbest, rbest = farthest(left, lbest, slack - right[rbest][3] + right[far][3]), far
        (i, j, more, _), (u, v, most, _) = left[lbest], right[rbest]
        i, j = i + 1, j + 1
        same, n = core + more + most, max(u - i, v - j)
        if same < plan.identity * n and len(r) > 1:  # parted at its worst gap
            worst = min(range(1, len(r)), key=lambda m: r[m][5])
            runs += [r[:worst], r[worst:]]
        elif same >= plan.min_words and same >= plan.identity * n:
            out.append((i, u, j, v, same))
    if out:
        sa, sb = ([m.span() for m in WORD.finditer(t)] for t in (low, other_low))
        out = [(sa[i][0], sa[u - 1][1], sb[j][0], sb[v - 1][1], u - i, same) for i, u, j, v, same in out[::-1]]
    return out, tuple(stopped)


PASSAGE = "uid bigint, first_uid bigint, start int, end int, first_start int, first_end int, n_words int, n_equal int"
ALIGNED = f"{PASSAGE}, cut boolean, xs array<int>, ys array<int>"


def even(texts: DataFrame) -> DataFrame:
    """(uid, width, raw) of texts (uid, text): each in the narrowest code that has width bytes for every character, so that a slice is cut without counting characters up to it."""
    n, two = F.length("text"), F.encode("text", "UTF-16BE")
    width = F.when((F.octet_length("text") == n) | ~F.col("text").rlike(r"[^\x00-\xff]"), 1).when(F.octet_length(two) == 2 * n, 2).otherwise(4)
    raw = F.when(F.octet_length("text") == n, F.col("text").cast("binary")).when(F.col("width") == 1, F.encode("text", "ISO-8859-1")).when(F.col("width") == 2, two).otherwise(F.encode("text", "UTF-32"))
    return texts.withColumn("width", width).select("uid", "width", raw.alias("raw"))


def piece(begin: Column, length: Column) -> Column:
    """The slice of length characters from begin (0 is the first) of an even() text."""
    width = F.col("width")
    cut = F.substring(F.col("raw"), begin * width + 1, length * width)
    return F.when(width == 1, F.decode(cut, "ISO-8859-1")).when(width == 2, F.decode(cut, "UTF-16BE")).otherwise(F.decode(cut, "UTF-32"))


def aligned_rows(found: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """PASSAGE rows of chains, and each chain (cut) whose alignment the slices' ends may have stopped, which has no other row; the slices are cut by the executors before they go to Python."""
    texts = even(maybe_among(docs.select("uid", "text"), "uid", found.select("uid").union(found.select("first_uid"))))

    def cut(offsets: str):
        begin = F.greatest(F.element_at(offsets, 1) - plan.margin, F.lit(0))
        length = F.element_at(offsets, -1) + 2 * plan.margin - begin
        return begin, piece(begin, length), F.octet_length("raw") > (begin + length) * F.col("width")

    a0, a_slice, a_more = cut("xs")
    one = found.join(texts, "uid").select("uid", "first_uid", "xs", "ys", a0.alias("a0"), a_slice.alias("a"), a_more.alias("a_more"))
    b0, b_slice, b_more = cut("ys")
    both = one.join(texts.withColumnRenamed("uid", "first_uid"), "first_uid")
    both = both.select("uid", "first_uid", "xs", "ys", "a0", "a", "a_more", b0.alias("b0"), b_slice.alias("b"), b_more.alias("b_more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ALIGNED.split(", ")]
        kinds = [pa.int64()] * 2 + [pa.int32()] * 6 + [pa.bool_()] + [pa.list_(pa.int32())] * 2
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("a")):
                rows = []
                for uid, first, xs, ys, a0, a, a_more, b0, b, b_more in zip(*(c.to_pylist() for c in part.columns)):
                    done, stopped = align(a, b, [x - a0 for x in xs], [y - b0 for y in ys], plan)
                    if any(x and more for x, more in zip(stopped, (a0, b0, a_more, b_more))):
                        rows.append((uid, first, *[None] * 6, True, xs, ys))
                        continue
                    for s, e, fs, fe, n, same in done:
                        rows.append((uid, first, s + a0, e + a0, fs + b0, fe + b0, n, same, False, None, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return both.mapInArrow(run, ALIGNED)


def passage_rows(found: DataFrame, docs: DataFrame, plan: Plan, label: str) -> DataFrame:
    """Aligned passages of chains, written; chains whose slices were too short are aligned again with longer ones until none is left."""
    done = None
    while True:
        aligned = materialize(aligned_rows(found, docs, plan), label)
        part = aligned.filter("NOT cut").select(*(x.split()[0] for x in PASSAGE.split(", ")))
        done = part if done is None else done.unionByName(part)
        found = aligned.filter("cut").select("uid", "first_uid", "xs", "ys")
        if found.isEmpty():
            return done
        plan = replace(plan, margin=min(4096 * plan.margin, 2**27))  # mostly the whole texts, which are read once more for it


# ---------------------------------------------------------------- whole windows


BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, by its words alone."""
    power, back = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h) - 1, b)))) for b in (BASE, UNBASE))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power)))
    out = (total[size:] - total[:-size]) * back[: len(h) - size + 1]
    return (out ^ (out >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)


def later_seeds(lists: DataFrame) -> DataFrame:
    """lists less the seeds that no earlier text has."""
    return lists.select("uid", F.filter("seeds", lambda s: s["first_uid"] < F.col("uid")).alias("seeds")).filter(F.size("seeds") > 0)


def stretches(seeds: pa.StructScalar, plan: Plan) -> Iterator[tuple[int, int, np.ndarray]]:
    """Where runs of at least min_words words begin and end, in characters, of whose windows the given seeds are the least shingles; and these seeds' hashes.

    Equal runs of words have the same seeds in this sense, whatever stands beside them.
    """
    at, place, h = (seeds.values.field(i).to_numpy() for i in range(3))
    first, before, behind = place >> 32, (place >> 14) & FAR, place & FAR
    past = first + ((place >> 28) & 15)
    cut = np.flatnonzero(first[1:] != past[:-1]) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(place)])) - 1
    words = past[end] - first[begin] + plan.seed_words + plan.window - 2
    for i in np.flatnonzero(words >= plan.min_words):
        x, y = begin[i], end[i]
        yield 0 if before[x] == FAR else int(at[x] - before[x]), 2**31 - 1 if behind[y] == FAR else int(at[y] + behind[y]), h[x : y + 1]


STRETCH = "uid bigint, begin int, end int, hs array<bigint>"


def stretch_rows(lists: DataFrame, plan: Plan) -> DataFrame:
    """STRETCH rows of (uid, seeds, begins, stops); what lies inside a span (begins, stops) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, found, begins, stops in zip(*b.columns):
                spans = list(zip(begins.as_py() or (), stops.as_py() or ()))
                for s, e, h in stretches(found, plan):
                    if not any(x <= s and e <= y for x, y in spans):
                        rows.append((uid.as_py(), s, e, h))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["uid", "begin", "end", "hs"])

    return lists.select("uid", "seeds", "begins", "stops").mapInArrow(run, STRETCH)


def apart(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which of the equal values in h, at ascending places, to keep: the first, each that is `size` places after the one kept before it, and the last."""
    keep = np.ones(len(h), bool)
    order = np.argsort(h, kind="stable")
    bounds = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0, [True])))
    for i in np.flatnonzero(np.diff(bounds) > 2):
        group = order[bounds[i] : bounds[i + 1]]
        last = at[group[0]]
        for i in group[1:-1].tolist():
            keep[i] = at[i] - last >= size
            last = at[i] if keep[i] else last
    return keep


def window_rows(texts: DataFrame, plan: Plan) -> DataFrame:
    """(h, uid, at, tail, open) of the windows of min_words words inside the stretches (begins, ends) of texts.

    tail is where the last seed_words words begin; a window inside a span (starts, stops) isn't open. Of equal windows
    of a text the first is kept, and of the open ones those that lie apart().
    """
    size = plan.min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text, *lists in zip(*b.columns):
                words, first, past = hashed_words(lower(text.as_py()))
                if len(words) < size:
                    continue
                begins, ends, starts, stops = (x.as_py() or () for x in lists)
                left, right = first[: len(words) - size + 1], past[size - 1 :]
                known, inside = np.zeros(len(left), bool), np.zeros(len(left), bool)
                for mask, bounds in ((known, zip(begins, ends)), (inside, zip(starts, stops))):
                    for s, e in bounds:
                        mask[np.searchsorted(left, s) : np.searchsorted(right, e, side="right")] = True
                at = np.flatnonzero(known)
                if not len(at):
                    continue
                h, wanted = window_hashes(words, size)[at].view(np.int64), ~inside[at]
                ever = np.unique(h, return_index=True)[1]
                keep = np.zeros(len(at), bool)
                keep[ever] = True
                opened = np.flatnonzero(wanted)
                if len(opened):
                    keep[opened[apart(h[opened], at[opened], size)]] = True
                cols = [h[keep], np.full(keep.sum(), uid.as_py()), first[at[keep]], first[at[keep] + size - plan.seed_words], wanted[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], ["h", "uid", "at", "tail", "open"])

    return texts.mapInArrow(run, "h bigint, uid bigint, at int, tail int, open boolean")


def found_spans(found: DataFrame) -> DataFrame:
    """(uid, begins, stops) of passages; a text bounds its spans."""
    return few_or_all(found.groupBy("uid").agg(F.collect_list("start").alias("begins"), F.collect_list("end").alias("stops")), found.count())


def window_passages(lists: DataFrame, found: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame | None:
    """Passages of exact runs of min_words words that found leaves open; lists has the seeds of two texts or more."""
    spans = found_spans(found)
    left_open = materialize(stretch_rows(later_seeds(lists).join(spans, "uid", "left"), plan), "open")
    wanted = materialize(left_open.select(F.explode("hs").alias("h")).distinct(), "wanted")
    if wanted.isEmpty():
        return None
    # a seed that passes without being wanted makes a stretch longer, but no window of two texts
    beside = lists.withColumn("_one", F.lit(1)).join(F.broadcast(bitmap_of(wanted)), "_one")  # one row
    again = beside.select("uid", F.filter("seeds", lambda s: maybe_in(s["h"])).alias("seeds")).filter(F.size("seeds") > 0)
    none = F.lit(None).cast("array<int>")
    near = stretch_rows(again.select("uid", "seeds", none.alias("begins"), none.alias("stops")), plan)
    near = materialize(near.groupBy("uid").agg(F.collect_list("begin").alias("lows"), F.collect_list("end").alias("highs")).join(spans, "uid", "left"), "near")  # a text bounds its stretches
    texts = maybe_among(docs.select("uid", "text"), "uid", near.select("uid"))
    rows = materialize(window_rows(texts.join(near, "uid").select("uid", "text", "lows", "highs", "begins", "stops"), plan), "windows")
    first = rows.groupBy("h").agg(F.min(F.struct("uid", "at", "tail")).alias("f"), F.max("uid").alias("last")).filter("last > f.uid")
    first = materialize(first.select("h", F.col("f.uid").alias("first_uid"), F.col("f.at").alias("first_at"), F.col("f.tail").alias("first_tail")), "firsts")
    met = rows.filter("open").join(first, "h").filter("uid > first_uid")
    ends = F.array(F.struct("at", "first_at"), F.struct(F.col("tail").alias("at"), F.col("first_tail").alias("first_at")))
    exact = replace(plan, least_seeds=1, loose_words=0, drop=0.0, most=plan.min_words)  # all windows of a run are there
    chained = materialize(chain_rows(met.select("uid", "first_uid", F.inline(ends)).distinct(), exact), "chains")
    for spent in (left_open, wanted, near, rows, first):
        discard(spent)
    more = passage_rows(chained, docs, exact, "exact")
    # of passages that lie inside another of the same text that one stays
    before = Window.partitionBy("uid").orderBy("start", F.desc("end"), "first_uid", "first_start").rowsBetween(Window.unboundedPreceding, -1)
    longest = more.withColumn("reached", F.max("end").over(before)).filter("reached IS NULL OR end > reached")
    return longest.drop("reached")


# ---------------------------------------------------------------- pairs of seeds


def covered(at: np.ndarray, begins: list[int], stops: list[int]) -> np.ndarray:
    """Which of the ascending offsets lie in a span."""
    out = np.zeros(len(at), bool)
    for s, e in zip(begins, stops):
        out[np.searchsorted(at, s) : np.searchsorted(at, e)] = True
    return out


def open_rows(lists: DataFrame, plan: Plan) -> DataFrame:
    """STRETCH rows of the runs of seeds of (uid, seeds, begins, stops) that no span covers, with pair_words between them at most and open_words or more from first to last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for uid, found, begins, stops in zip(*b.columns):
                at, place, h = (found.values.field(i).to_numpy() for i in range(3))
                left = np.flatnonzero(~covered(at, begins.as_py() or (), stops.as_py() or ()))
                if len(left) < plan.least_seeds:
                    continue
                word = place[left] >> 32
                bounds = np.concatenate(([0], np.flatnonzero(np.diff(word) > plan.pair_words) + 1, [len(left)]))
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    if y - x >= plan.least_seeds and word[y - 1] - word[x] >= plan.open_words:
                        rows.append((uid.as_py(), int(at[left[x]]), int(at[left[y - 1]]) + 1, h[left[x:y]]))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["uid", "begin", "end", "hs"])

    return lists.select("uid", "seeds", "begins", "stops").mapInArrow(run, STRETCH)


PAIR = "pair bigint, uid bigint, at int, next_at int, open boolean, known bigint"


def pair_rows(lists: DataFrame, plan: Plan) -> DataFrame:
    """PAIR rows of (uid, seeds, lows, highs): a hash of each two seeds of which at most pair_steps - 1 lie between; open says that both lie in one stretch (lows, highs); known is the first text of both seeds, if it is the same and they are the text's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
        for b in batches:
            uids, found, lows, highs = b.columns
            seeds = found.flatten()
            at, place, h, first, lead = (seeds.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 5))
            text = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False))  # of each seed; a batch's texts at once
            uid, first = uids.to_numpy()[text], np.where(lead, first, -1)
            word, mixed, unmixed = place >> 32, h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), h.view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
            where, stretch = (text << 32) + at, np.full(len(at), -1)
            of = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(lows), 0).to_numpy(zero_copy_only=False)) << 32
            edges = (np.searchsorted(where, of + x.flatten().to_numpy()).tolist() for x in (lows, highs))
            for m, (x, y) in enumerate(zip(*edges)):
                stretch[x:y] = m
            parts = []
            for step in range(1, plan.pair_steps + 1):
                near = np.flatnonzero((text[step:] == text[:-step]) & (word[step:] - word[:-step] <= plan.pair_words))
                parts.append((near, near + step))
            one, two = map(np.concatenate, zip(*parts))
            order = np.argsort(text[one], kind="stable")  # a text's rows together, which are written in less room
            one, two = one[order], two[order]
            key = mixed[one] ^ unmixed[two]
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            opened, known = (stretch[one] >= 0) & (stretch[one] == stretch[two]), np.where(first[one] == first[two], first[one], -1)
            if len(one):
                cols = [key.view(np.int64), uid[one], at[one], at[two], opened, known]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split(" ")[0] for f in PAIR.split(", ")])

    return lists.select("uid", "seeds", "lows", "highs").mapInArrow(run, PAIR)


def pair_passages(lists: DataFrame, found: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame | None:
    """Passages through seeds that found leaves open: by pairs of seeds with the first text that has the pair, and by all of a text's occurrences of a seed.

    A pair across a place where texts with one part meet those with another is first seen where both parts stand together.
    """
    spans = found_spans(found)
    left_open = materialize(open_rows(later_seeds(lists).join(spans, "uid", "left"), plan), "open")
    wanted = materialize(left_open.select(F.explode("hs").alias("h")).distinct(), "wanted")
    if wanted.isEmpty():
        return None
    ranges = left_open.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("r")).select("uid", F.col("r.begin").alias("lows"), F.col("r.end").alias("highs"))  # a text bounds its stretches
    ranges = materialize(ranges, "ranges")
    again = materialize(maybe_among(lists.select("uid", F.inline("seeds")), "h", wanted).join(few_or_all(wanted, wanted.count()), "h", "left_semi"), "again")
    pairs = materialize(pair_rows(seed_lists(again).join(ranges, "uid", "left"), plan), "pairs")
    first = pairs.groupBy("pair").agg(F.min(F.struct("uid", "at", "next_at")).alias("f"), F.max("uid").alias("last"), F.max("open").alias("open")).filter("open AND last > f.uid")
    first = materialize(first.select("pair", F.col("f.uid").alias("first_uid"), F.col("f.at").alias("first_at"), F.col("f.next_at").alias("first_next")), "firsts")
    # seeds that both were matched with this text before gave no passage
    met = pairs.filter("open").join(first, "pair").filter("uid > first_uid AND first_uid <> known")
    ends = F.array(F.struct("at", "first_at"), F.struct(F.col("next_at").alias("at"), F.col("first_next").alias("first_at")))
    linked = met.select("uid", "first_uid", F.inline(ends))
    # a text's later occurrences of a seed, which weren't matched before, beside its first ones
    inside = again.filter("uid > first_uid").join(ranges, "uid").filter(F.exists(F.arrays_zip("lows", "highs"), lambda r: (r["lows"] <= F.col("at")) & (F.col("at") < r["highs"])))
    repeats = materialize(inside.filter("NOT lead").select("uid").distinct(), "repeats")
    others = inside.join(repeats, "uid", "left_semi").select("uid", "first_uid", "at", "first_at")
    chained = materialize(chain_rows(linked.unionByName(others).distinct(), plan), "chains")
    for spent in (left_open, wanted, ranges, again, pairs, first, repeats):  # before texts are shuffled
        discard(spent)
    more = passage_rows(chained, docs, plan, "pair-passages")
    discard(chained)
    before = Window.partitionBy("uid").orderBy("start", F.desc("end"), "first_uid", "first_start").rowsBetween(Window.unboundedPreceding, -1)
    longest = more.withColumn("reached", F.max("end").over(before)).filter("reached IS NULL OR end > reached").drop("reached")
    # one that a found span holds is known already
    held = longest.join(spans, "uid", "left").filter(~F.coalesce(F.exists(F.arrays_zip("begins", "stops"), lambda r: (r["begins"] <= F.col("start")) & (F.col("end") <= r["stops"])), F.lit(False)))
    return held.drop("begins", "stops")


# ---------------------------------------------------------------- DataFrames


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a column uid that tells its rows apart: doc_id where that is whole and unique, else a written row number."""
    odd = small_batches(docs).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        return docs.withColumn("uid", F.col("doc_id").cast("long"))
    placed = docs.withColumn("uid", F.monotonically_increasing_id())  # parts the rows of one id, however many they are
    order = F.col("doc_id").asc_nulls_last(), F.col("uid")
    ranged = placed.repartitionByRange(wide(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("uid", F.monotonically_increasing_id()), "numbered")


def passages(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Repeated passages of numbered docs: uid, first_uid, start, end, first_start, first_end, n_words, n_equal.

    start and end are character offsets into the text of uid; first_uid has the passage before it and keeps it.
    """
    lists = repeated_seeds(docs, plan)
    chained = materialize(list_chains(lists, plan), "chains")  # a text that repeats itself is met at its first place
    found = passage_rows(chained, docs, plan, "passages")
    discard(chained)
    for finder in (window_passages, pair_passages):
        more = finder(lists, found, docs, plan)
        found = found if more is None else found.unionByName(materialize(more, "more"))
    discard(lists)
    return found


def repeated_passages(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """passages() under doc_id and first_doc_id."""
    rows = numbered(docs.select("doc_id", "text"))
    found = passages(rows, plan)
    if hasattr(rows, "written_at"):
        ids = rows.select("uid", "doc_id")
        named = found.join(ids, "uid").join(ids.select(F.col("uid").alias("first_uid"), F.col("doc_id").alias("first_doc_id")), "first_uid")
    else:  # the ids are the numbers
        kind = docs.schema["doc_id"].dataType
        named = found.withColumn("doc_id", F.col("uid").cast(kind)).withColumn("first_doc_id", F.col("first_uid").cast(kind))
    identity = F.col("n_equal") / F.greatest("n_words", F.col("n_equal"))
    return named.select("doc_id", "first_doc_id", "start", "end", "first_start", "first_end", "n_words", "n_equal", identity.alias("identity"))


def without_repeats(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """docs with every passage cut out that a text with a smaller id has; rows of which no word is left go.

    n_chars, if there is such a column, is the length of what is left. Rows with null texts stay.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("string")).alias("rest"))  # so that no name clashes
    rows = numbered(packed)
    spans = passages(rows, plan).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))  # a text bounds its spans
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(acc, s):
        piece = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["kept"], piece).alias("kept"))

    spans = materialize(spans, "spans")
    n = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(spans) if n <= BROADCAST_KEYS else spans, "uid", "left")
    done = joined.withColumn("done", F.when(F.col("spans").isNotNull(), F.aggregate("spans", empty, step)))
    cut = F.concat(F.col("done.kept"), F.substring(F.col("text"), F.col("done.at") + 1, F.length("text")))
    out = done.select("doc_id", F.coalesce(cut, F.col("text")).alias("text"), "rest", F.col("spans").isNotNull().alias("changed"))
    out = out.filter(~F.col("changed") | F.col("text").rlike(r"(?U)\w"))

    def column(name: str):
        if name in ("doc_id", "text"):
            return F.col(name)
        kept = F.col("rest").getField(name)
        if name == "n_chars":
            kept = F.when(F.col("changed"), F.length("text").cast(docs.schema[name].dataType)).otherwise(kept)
        return kept.alias(name)

    return out.select(*map(column, docs.columns))
