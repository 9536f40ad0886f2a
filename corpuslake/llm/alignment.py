"""Cross-tokenizer alignment by a dictionary of groups.

Each text is encoded by two tokenizers, A with a space in front (a byte-level BPE) and B (a piece model, which puts that space itself).
Where a token of either ends at the same byte, the text is cut; what lies between two cuts is a group: some A ids and some
B ids. An A and a B token of a group are linked. Every pair of ids counts in how many documents it is linked.

Neither tokenizer has a token across a single space between two words (A's pattern and B's whitespace marker begin tokens
there), so a text falls into units. A worker keeps a lexicon of units with their groups and encodes a unit when it first
meets it. A unit whose bytes come back otherwise has its text encoded as one whole unit, which decides by the
definition. Of a block of rows come three kinds of rows:

* its distinct groups, with a 128-bit hash of the ids as key and the ids' counts,
* its pairs of ids, each with the number of the block's documents that hold it: links are expanded once for each
  distinct group, and counted by distinct documents,
* its documents, with their groups' places in the block's list and how often each occurs.

Pairs are summed over all blocks. Each distinct group of the corpus is expanded once more, meets its pairs' counts, and
gets the sum of its links' counts and the number of its best links; these go back by the group's key to the blocks
that have it and, times the frequencies, to the documents. A block ends after `block_bytes` characters (and what one more
slice of a batch adds), a lexicon of more than `lexicon_units` begins anew with the next block, and a long text is taken in
pieces, cut between units.

Null and empty texts, and texts that one of the tokenizers doesn't give back byte for byte, have no tokens: zeros, and an
empty groups_sha256. Every row is a document, also if it repeats an id or a text; of ties in count all are best; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import discard, materialize, slices, small_batches, wide

#: A single space between a character that is no space and one that is no white space.
BETWEEN = re.compile(r"(?<=[^ ]) (?=\S)")
#: Units that are encoded in one call.
TOGETHER = 4096
#: Characters of a piece of a text.
PIECE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters for themselves, others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[x] for x in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = ([str(i) for i in range(len(v))] for v in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a space and text by A and of text by B, or nothing if either's bytes are others."""
        said = (" " + text).encode("utf-8", "surrogatepass")
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        if b"".join(map(self.a_bytes.__getitem__, a)) != said:
            return None
        b = self.b.encode(text)
        return (a, b) if b"".join(map(self.b_bytes.__getitem__, b)) == said else None


@lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A space and text, cut between units after about so many characters."""
    full, at = " " + text, 0
    while len(full) - at > size and (m := BETWEEN.search(full, at + size)):
        yield full[at : m.start()]
        at = m.start()
    yield full[at:]


def units(piece: str) -> list[str]:
    """The units of a piece, each without the space in front."""
    return BETWEEN.split(piece[1:]) if piece[1:2] != " " else [x[k == 0 :] for k, x in enumerate(BETWEEN.split(piece))]


class Lexicon:
    """The units met so far, with their groups as numbers of first occurrence. What it holds changes no result."""

    def __init__(self, tokenizers: Pair):
        self.two = tokenizers
        self.numbers: dict[str, int] = {}
        #: By unit: its groups (None if its bytes come back otherwise), and tokens of A and B.
        self.groups: list[list[int] | None] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        #: By group: its distinct ids of A and how often each, the same of B, its links, distinct pairs and name.
        self.counted: list[tuple[list[int], list[int], list[int], list[int]]] = []
        self.links: list[int] = []
        self.pairs: list[np.ndarray] = []
        self.names: list[str] = []
        #: A group's number by its pair of ids or, if it has more, by its name.
        self.single: dict[int, int] = {}
        self.longer: dict[str, int] = {}

    def numbered(self, said: list[str]) -> list[int]:
        """The numbers of units; new ones are learnt first."""
        if None in (found := list(map(self.numbers.get, said))):
            self.learn([u for u in dict.fromkeys(said) if u not in self.numbers])
            found = list(map(self.numbers.__getitem__, said))
        return found

    def learn(self, fresh: list[str]) -> None:
        """Units that another could not stand beside as in a text, at a text's begin or end, are encoded alone."""
        edge = [u for u in fresh if u[:1].isspace() or u[-1:] in (" ", "")]
        inner = fresh if not edge else [u for u in fresh if not (u[:1].isspace() or u[-1:] in (" ", ""))]
        for part in [*([u] for u in edge), *(inner[k : k + TOGETHER] for k in range(0, len(inner), TOGETHER))]:
            self.numbers.update(zip(part, range(len(self.groups), len(self.groups) + len(part))))
            self._encode(part)

    def _add(self, a: list[int], b: list[int], name: str) -> int:
        of_a, of_b = Counter(a), Counter(b)
        self.counted.append(([*of_a], [*of_a.values()], [*of_b], [*of_b.values()]))
        self.links.append(len(a) * len(b))
        self.pairs.append(np.add.outer(np.array([*of_a], np.int64) << 32, np.array([*of_b], np.int64)).ravel())
        self.names.append(name)
        return len(self.names) - 1

    def _group(self, a: list[int], b: list[int]) -> int:
        name = f"{','.join([self.two.a_name[i] for i in a])}|{','.join([self.two.b_name[i] for i in b])}"
        n = self.longer.get(name)
        if n is None:
            n = self.longer[name] = self._add(a, b, name)
        return n

    def _single(self, a: int, b: int) -> int:
        n = self.single.get(a << 32 | b)
        if n is None:
            n = self.single[a << 32 | b] = self._add([a], [b], f"{a}|{b}")
        return n

    def _encode(self, fresh: list[str]) -> None:
        """Encodes units and numbers their groups."""
        found = self.two.encode(" ".join(fresh))
        if found is None:
            if len(fresh) == 1:
                self.groups.append(None)
                self.n_a.append(0)
                self.n_b.append(0)
            else:
                half = len(fresh) // 2
                self._encode(fresh[:half])
                self._encode(fresh[half:])
            return
        a, b = (np.array(x, np.int64) for x in found)
        a_end, b_end = np.cumsum(self.two.a_size[a]), np.cumsum(self.two.b_size[b])
        both = b_end[np.searchsorted(b_end, a_end)] == a_end  # both end with the text
        cut = a_end[both]
        unit_end = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in fresh])
        at = np.searchsorted(cut, unit_end)
        if not (cut[at] == unit_end).all():
            raise RuntimeError("a token goes across a space between words; these tokenizers don't fit")
        a_stop, b_stop = np.flatnonzero(both) + 1, np.searchsorted(b_end, cut) + 1
        a_n, b_n = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        one = (a_n == 1) & (b_n == 1)
        numbers = np.empty(len(cut), np.int64)
        code, back = np.unique(a[a_stop[one] - 1] << 32 | b[b_stop[one] - 1], return_inverse=True)
        numbers[one] = np.array([self._single(c >> 32, c & 0xFFFFFFFF) for c in code.tolist()], np.int64)[back]
        ids_a, ids_b = found
        numbers[~one] = [self._group(ids_a[x - i : x], ids_b[y - j : y]) for x, i, y, j in zip(*(v[~one].tolist() for v in (a_stop, a_n, b_stop, b_n)))]
        numbers, stops = numbers.tolist(), (at + 1).tolist()
        self.groups += [numbers[g:h] for g, h in zip([0, *stops], stops)]
        self.n_a += np.diff(a_stop[at], prepend=0).tolist()
        self.n_b += np.diff(b_stop[at], prepend=0).tolist()


@lru_cache(maxsize=1)
def kept_lexicon(a_path: str, b_path: str) -> list[Lexicon]:
    """A place for a worker's lexicon, from block to block."""
    return [Lexicon(pair(a_path, b_path))]


class Block:
    """Rows of one partition, with their groups as numbers of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.docs: list[tuple[int | None, int, int, str]] = []
        self.groups: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None, said: list[str] | None = None) -> None:
        """said: the text's units, if they have been made already; all of the text then is one piece."""
        every, n_a, n_b, digest = [], 0, 0, hashlib.sha256()
        if text:
            self.bytes += len(text)
            for units_of in [said] if said else map(units, pieces(text)) if "▁" not in text else ():
                if not self._add(units_of, every, digest):
                    every = []
                    break
            if not every:  # a unit's bytes are others: the whole text decides
                digest = hashlib.sha256()
                self._add([text], every, digest)
        if every:
            n_a, n_b = (sum(x[k] for x in every) for k in (1, 2))
        self.docs.append((doc_id, n_a, n_b, digest.hexdigest() if every else ""))
        self.groups.append(np.concatenate([x[0] for x in every]) if every else np.empty(0, np.int32))

    def _add(self, said: list[str], every: list, digest) -> bool:
        lexicon = self.lexicon
        numbers = lexicon.numbered(said)
        found = list(map(lexicon.groups.__getitem__, numbers))
        if None in found:
            return False
        flat = list(chain.from_iterable(found))
        digest.update(((";" if every else "") + ";".join(map(lexicon.names.__getitem__, flat))).encode())
        every.append((np.array(flat, np.int32), *(sum(map(n.__getitem__, numbers)) for n in (lexicon.n_a, lexicon.n_b))))
        return True

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        sizes = [len(g) for g in self.groups]
        self.used, group = np.unique(np.concatenate([np.empty(0, np.int32), *self.groups]), return_inverse=True)
        key, often = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(self.used)) + group, return_counts=True)
        doc, group = np.divmod(key, max(1, len(self.used)))
        yield from self.group_rows(block)
        yield from self.pair_rows(block, doc, group)
        yield from self.doc_rows(block, doc, group, often)

    def group_rows(self, block: int) -> Iterator[pa.RecordBatch]:
        keys = [xxhash.xxh3_128_digest(self.lexicon.names[g]) for g in self.used.tolist()]
        counted = [self.lexicon.counted[g] for g in self.used.tolist()]
        for k in range(0, len(keys), 8192):
            part = counted[k : k + 8192]
            yield batch(len(part), kind=GROUP, block=block, place=range(k, k + len(part)), group=keys[k : k + 8192], **dict(zip(("a", "n_of_a", "b", "n_of_b"), zip(*part))))

    def pair_rows(self, block: int, doc: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(doc):
            return
        expanded = [self.lexicon.pairs[g] for g in self.used.tolist()]
        size = np.fromiter(map(len, expanded), np.int64, len(expanded))
        start = np.cumsum(size) - size
        known, pair_of = np.unique(np.concatenate(expanded), return_inverse=True)
        counts = np.zeros(len(known), np.int64)
        begins = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        step = max(1, len(begins) // max(1, int(size[group].sum()) // 4_000_000))  # documents together, so that their pairs are a few million
        for k in range(0, len(begins), step):
            a, z = begins[k], begins[k + step] if k + step < len(begins) else len(doc)
            n = size[group[a:z]]
            spots = np.repeat(start[group[a:z]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            counts += np.bincount(np.unique(np.repeat(doc[a:z], n) * len(known) + pair_of[spots]) % len(known), minlength=len(known))
        for k in range(0, len(known), 65_536):
            part = known[k : k + 65_536]
            yield batch(len(part), kind=PAIR, a_id=part >> 32, b_id=part & 0xFFFFFFFF, n=counts[k : k + 65_536])

    def doc_rows(self, block: int, doc: np.ndarray, group: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
        links = np.array([self.lexicon.links[g] for g in self.used.tolist()], np.int64)
        ends = np.searchsorted(doc, np.arange(len(self.docs)), "right").tolist()
        held, z = [], 0
        for (doc_id, n_a, n_b, digest), end in zip(self.docs, ends):
            a, z = z, end
            places = np.diff(group[a:z], prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + often[a:z].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if z > a else b""
            held.append((doc_id, n_a, n_b, int(often[a:z].sum()), int((links[group[a:z]] * often[a:z]).sum()), digest, zstandard.compress(places, 1)))
            if len(held) >= 512:
                yield doc_batch(block, held)
                held = []
        if held:
            yield doc_batch(block, held)


GROUP, PAIR, VALUE, DOC = 0, 1, 2, 3
KINDS = {
    "kind": pa.int32(), "block": pa.int64(), "place": pa.int32(), "group": pa.binary(), "a": pa.list_(pa.int32()), "n_of_a": pa.list_(pa.int32()), "b": pa.list_(pa.int32()), "n_of_b": pa.list_(pa.int32()),
    "a_id": pa.int32(), "b_id": pa.int32(), "n": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "places": pa.binary(),
}
ROW = ", ".join(f"{k} {'binary' if k in ('group', 'places') else 'string' if k == 'groups_sha256' else 'array<int>' if k in ('a', 'b', 'n_of_a', 'n_of_b') else 'int' if k in ('kind', 'place', 'a_id', 'b_id') else 'bigint'}" for k in KINDS)


def batch(size: int, **columns) -> pa.RecordBatch:
    made = []
    for name, kind in KINDS.items():
        values = columns.get(name)
        made.append(pa.nulls(size, kind) if values is None else pa.array([values] * size, kind) if isinstance(values, int) else pa.array(values, kind))
    return pa.RecordBatch.from_arrays(made, list(KINDS))


def doc_batch(block: int, held: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places")
    return batch(len(held), kind=DOC, block=block, **dict(zip(names, map(list, zip(*held)))))


def aligned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int, lexicon_units: int) -> DataFrame:
    """ROW rows of docs (doc_id, text). The number of a block is its partition's and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, number, block = kept_lexicon(a_path, b_path), TaskContext.get().partitionId() << 32, None
        for b in batches:
            for part in slices(b, 1):
                if block is None or block.bytes >= block_bytes:
                    if block:
                        yield from block.rows(number)
                        number += 1
                    if len(kept[0].groups) > lexicon_units:
                        kept[0] = Lexicon(kept[0].two)
                    block = Block(kept[0])
                texts = part.column(1).to_pylist()
                said = [units(" " + t) if t and len(t) <= PIECE and "▁" not in t else None for t in texts]
                kept[0].learn([u for u in dict.fromkeys(chain.from_iterable(filter(None, said))) if u not in kept[0].numbers])
                for doc_id, text, own in zip(part.column(0).to_pylist(), texts, said):
                    block.add(doc_id, text, own)
        if block:
            yield from block.rows(number)

    return docs.mapInArrow(run, ROW)


# ---------------------------------------------------------------- the corpus


def counted_pairs(rows: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): in how many documents a pair is linked, and whether no other pair of its A id is in more."""
    pairs = materialize(rows.filter(F.col("kind") == PAIR).groupBy("a_id", "b_id").agg(F.sum("n").alias("n")), "pairs")
    most = pairs.groupBy("a_id").agg(F.max("n").alias("most"))
    out = materialize(pairs.join(most, "a_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "counted")  # an A id has at most B's vocabulary of pairs
    discard(pairs)
    return out


def group_values(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(group, count_sum, n_best) of each distinct group."""
    groups = rows.filter(F.col("kind") == GROUP).select("group", "a", "n_of_a", "b", "n_of_b").dropDuplicates(["group"])
    by_a = groups.select("group", "b", "n_of_b", F.explode(F.arrays_zip("a", "n_of_a")).alias("x"))
    links = by_a.select("group", F.col("x.a").alias("a_id"), F.col("x.n_of_a").alias("n_of_a"), F.explode(F.arrays_zip("b", "n_of_b")).alias("y"))
    links = links.select("group", "a_id", F.col("y.b").alias("b_id"), (F.col("n_of_a").cast("long") * F.col("y.n_of_b")).alias("times"))
    met = links.join(pairs, ["a_id", "b_id"])
    return met.groupBy("group").agg(F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
JOINED = ["block", "kind", "place", "count_sum", "n_best", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places"]


def summed(rows: DataFrame) -> DataFrame:
    """Documents with the sums over their groups; rows has the values of each block's groups before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, values = None, [], None
        for b in batches:
            blocks, kinds = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            changes = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *changes.tolist()], [*changes.tolist(), b.num_rows]):
                if end == begin:
                    continue
                if blocks[begin] != at:
                    at, held, values = blocks[begin], [], None
                part = b.slice(begin, end - begin)
                if kinds[begin] == VALUE:
                    held.append(np.stack([part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4)]))
                    continue
                if values is None:
                    values = np.concatenate(held, axis=1) if held else np.empty((2, 0), np.int64)
                sums = []
                for blob in part.column(11).to_pylist():
                    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
                    n = len(raw) // 8
                    delta, often = (np.ascontiguousarray(x.reshape(4, n).T).view("<u4").ravel().astype(np.int64) for x in (raw[: 4 * n], raw[4 * n :]))
                    sums.append((values[:, np.cumsum(delta)] * often).sum(axis=1) if n else (0, 0))
                count_sum, n_best = (pa.array([int(x[k]) for x in sums], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5, 10)), n_best, count_sum, part.column(10)], [f.split(" ")[0] for f in RESULT.split(", ")])

    n = wide(rows.sparkSession)
    return rows.repartition(n, "block").sortWithinPartitions("block", "kind", "place").mapInArrow(run, RESULT)


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = 8 << 20, lexicon_units: int = 300_000) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a_path: a byte-level BPE of the tokenizers library; b_path: a sentencepiece model with byte fallback; block_bytes:
    characters of a block of rows (a slice of a batch may add to it); lexicon_units: units after which a worker begins its lexicon anew.
    """
    chosen = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    rows = materialize(aligned(chosen, a_path, b_path, block_bytes, lexicon_units), "aligned")
    pairs = counted_pairs(rows)
    values = materialize(group_values(rows, pairs), "group-values")
    discard(pairs)
    back = rows.filter(F.col("kind") == GROUP).select("block", "place", "group").join(values, "group")
    none = {c: F.lit(None) for c in JOINED}
    back = back.select(*({**none, "block": F.col("block"), "kind": F.lit(VALUE), "place": F.col("place"), "count_sum": F.col("count_sum"), "n_best": F.col("n_best")}[c].alias(c) for c in JOINED))
    own = rows.filter(F.col("kind") == DOC).select(*(F.lit(None).cast("long").alias(c) if c in ("count_sum", "n_best") else F.col(c) for c in JOINED))
    return summed(own.unionByName(back))
