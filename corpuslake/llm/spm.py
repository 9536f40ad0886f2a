"""SentencePiece encoding and decoding over a table of distinct chunks.

A chunk is a run of whitespace markers with what follows up to the next marker. No piece of the model has a
marker after another character, and merges only make pieces, so none crosses a chunk's begin: each distinct
chunk is segmented once by the library and its ids are joined back by position. `Segmenter` verifies this of the
model; for another model whole texts are encoded.

The join goes by blocks, since a shuffle of every chunk of a corpus would be larger than the corpus. A block is a run
of rows of one input partition with at most `block_chunks` distinct chunks (and what one more text adds). Each block sends its list of
distinct chunks, in parts by a hash of the chunk, to the table; a part of the table segments each of its chunks
once, whichever blocks have it, and sends ids back to the blocks, in the order of their lists. There they meet the
texts, written as places in the block's list. The input is read twice, once for the lists and once for the texts. A block's
key is a 128-bit hash of its list, so that an input which changes between (rows in another order after a lost shuffle)
ends in an error and never in other ids, and blocks with equal lists can share them; rows that come out of a shuffle should be written first. A part of the table starts
anew beyond `table_limit` chunks; what was dropped is segmented again if it comes again, so the bound changes no result.

Null texts are as empty ones (the begin and end ids alone); a text of any length is in one block, whole; repeated rows and
ties give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import slices, small_batches, wide

MARK = "▁"
CHUNKS = re.compile(" +[^ ]*")
#: Parts of the table for each shuffle partition.
PARTS = 4
BLOCK_BYTES = 32 << 20


class Segmenter:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces) and self._plain()
        #: What a single space at a text's end leaves: a marker with nothing behind it, which the library gives to no text of its own.
        self.lone = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()

    def _plain(self) -> bool:
        """Whether the model keeps every space and puts one marker in front, with no other normalisation of these probes."""
        probes = ("a", " a", "a ", "a  b ", "ﬁ 　 x", "éé", "Ａ\t\n")
        return all(self.sp.decode(self.sp.encode(p)) == p for p in probes) and self.sp.encode_as_pieces("a")[:1] in ([MARK + "a"], [MARK])

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk (without its first marker) as little-endian 32-bit numbers."""
        return [np.array(v, "<u4").tobytes() if k else self.lone for k, v in zip(chunks, self.sp.encode(chunks, num_threads=1))]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text in order, each without its first marker."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [m[1:] for m in CHUNKS.findall(" " + text)]


@lru_cache(maxsize=2)
def segmenter(model: str) -> Segmenter:
    return Segmenter(model)


# ---------------------------------------------------------------- packed lists


def packed(counts: np.ndarray, data: bytes) -> bytes:
    """Consecutive pieces of data of these lengths, as one compressed value."""
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(counts)).tobytes() + counts.astype("<u4").tobytes() + data)


def unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:4], "<u4")[0])
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n :]


def packed_texts(texts: list[str]) -> bytes:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    return packed(np.fromiter(map(len, data), np.int64, len(data)), b"".join(data))


def unpacked_texts(blob: bytes) -> list[str]:
    counts, data = unpacked(blob)
    ends = np.cumsum(counts).tolist()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]


# ---------------------------------------------------------------- blocks


class Block:
    """Rows of one partition: their ids, their chunks as numbers of first occurrence, and the distinct chunks."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.rows: list[tuple[pa.Array, np.ndarray, list[np.ndarray]]] = []
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        numbers, lists = self.numbers, []
        for t in texts:
            keys = Segmenter.chunks(t or "")
            for k in keys:
                if k not in numbers:
                    numbers[k] = len(numbers)
            lists.append(np.fromiter(map(numbers.__getitem__, keys), np.int32, len(keys)))
            self.bytes += 4 * len(keys)
        self.rows.append((ids, np.fromiter(map(len, lists), np.int64, len(lists)), lists))

    def parts(self, n: int) -> tuple[list[tuple[int, list[str]]], np.ndarray]:
        """(part of the table, its chunks in order) of the distinct chunks, and each chunk's place in all these lists."""
        chunks = list(self.numbers)
        part = np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) % n for k in chunks), np.int64, len(chunks))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(chunks), np.int64)
        place[order] = np.arange(len(chunks))
        begin = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) != 0))) if len(chunks) else []
        groups = np.split(order, begin[1:]) if len(chunks) else []
        return [(int(part[g[0]]), [chunks[i] for i in g.tolist()]) for g in groups], place


ROW = "block binary, part int, doc_ids binary, blob binary"


def block_rows(docs: DataFrame, parts: int, lists: bool, block_chunks: int) -> DataFrame:
    """ROW rows of the blocks of docs (doc_id, text): either their lists of distinct chunks, one for each part of the table,
    or their texts as places in these lists, with `parts` for the part; a text's row counts the list's chunks too."""

    def flush(block: Block) -> Iterator[pa.RecordBatch]:
        found, place = block.parts(parts)
        blobs = [packed_texts(chunks) for _, chunks in found]
        key = xxhash.xxh3_128_digest(b"".join(blobs))
        if lists:
            rows = [(key, p, None, blob) for (p, _), blob in zip(found, blobs)]
        else:
            rows = []
            for ids, counts, numbers in block.rows:
                places = place[np.concatenate(numbers)] if len(numbers) else np.empty(0, np.int64)
                kept = pa.BufferOutputStream()
                with pa.ipc.new_stream(kept, pa.schema([("doc_id", pa.int64())])) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
                counted = np.concatenate(([len(place)], counts))
                rows.append((key, parts, kept.getvalue().to_pybytes(), packed(counted, places.astype("<u4").tobytes())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "doc_ids", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for b in batches:
            for piece in slices(b, 1):
                if len(block.numbers) >= block_chunks or block.bytes >= BLOCK_BYTES:
                    yield from flush(block)
                    block = Block()
                block.add(piece.column(0), piece.column(1).to_pylist())
        yield from flush(block)

    return docs.mapInArrow(run, ROW)


# ---------------------------------------------------------------- the table


def table_ids(lists: DataFrame, model: str, parts: int, table_limit: int) -> DataFrame:
    """For each list of a block the ids of its chunks, in order; each distinct chunk of a part is segmented once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, table, at = segmenter(model), {}, None
        for b in batches:
            for row in range(b.num_rows):
                part = b.column(1)[row].as_py()
                if part != at or len(table) > table_limit:
                    table, at = {}, part
                chunks = unpacked_texts(b.column(3)[row].as_py())
                fresh = [k for k in chunks if k not in table]
                table.update(zip(fresh, seg.segment(fresh)))
                ids = [table[k] for k in chunks]
                blob = packed(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, b"".join(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, 1), b.column(1).slice(row, 1), pa.nulls(1, pa.binary()), pa.array([blob], pa.binary())], ["block", "part", "doc_ids", "blob"])

    n = wide(lists.sparkSession)
    return lists.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, ROW)


# ---------------------------------------------------------------- texts


RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
KEPT = ", ids array<int>, decoded string"


def result_batch(doc_ids: pa.Array, encoded: list[bytes], decoded: list[str], keep_ids: bool) -> pa.RecordBatch:
    cols = [
        doc_ids,
        pa.array([len(i) // 4 for i in encoded], pa.int64()),
        pa.array([hashlib.sha256(i).hexdigest() for i in encoded], pa.string()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded], pa.string()),
    ]
    if keep_ids:
        cols += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in encoded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in (RESULT + KEPT * keep_ids).split(", ")])


def joined(rows: DataFrame, model: str, parts: int, keep_ids: bool) -> DataFrame:
    """Results of texts (ROW rows of part `parts`) and the ids of their blocks' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, at = segmenter(model), None
        begin, end = (np.array([x], "<u4").tobytes() for x in (seg.sp.bos_id(), seg.sp.eos_id()))
        held: list[tuple[np.ndarray, bytes]] = []
        length = start = ids = None
        for b in batches:
            for row in range(b.num_rows):
                block, part = b.column(0)[row].as_py(), b.column(1)[row].as_py()
                if block != at:
                    at, held, ids, last = block, [], None, -1
                counts, data = unpacked(b.column(3)[row].as_py())
                if part < parts:
                    if part > last:  # else another block has the same lists
                        held.append((counts, data))
                    last = part
                    continue
                if ids is None:  # the block's lists are complete
                    length = np.concatenate([np.empty(0, np.int64), *(c for c, _ in held)])
                    start = np.cumsum(length) - length
                    ids = np.frombuffer(b"".join(d for _, d in held), "<u4")
                if counts[0] != len(length):
                    raise RuntimeError("the input changed between its two readings; write it before it is encoded")
                places = np.frombuffer(data, "<u4").astype(np.int64)
                size = length[places]
                first = np.cumsum(size) - size
                flat = ids[np.repeat(start[places] - first, size) + np.arange(int(size.sum()))].astype("<u4")
                ends = np.concatenate((first, [len(flat)]))[np.cumsum(counts[1:])]
                encoded = [begin + flat[a:z].tobytes() + end for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
                decoded = seg.sp.decode([np.frombuffer(i, "<u4").tolist() for i in encoded], num_threads=1)
                doc_ids = pa.ipc.open_stream(b.column(2)[row].as_py()).read_next_batch().column(0)
                yield result_batch(doc_ids, encoded, decoded, keep_ids)

    n = wide(rows.sparkSession)
    return rows.repartition(n, "block").sortWithinPartitions("block", "part").mapInArrow(run, RESULT + KEPT * keep_ids)


def whole_texts(docs: DataFrame, model: str, keep_ids: bool) -> DataFrame:
    """The same for a model whose pieces may cross markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = segmenter(model).sp
        for b in batches:
            for piece in slices(b, 1):
                ids = sp.encode([t or "" for t in piece.column(1).to_pylist()], add_bos=True, add_eos=True, num_threads=1)
                yield result_batch(piece.column(0), [np.array(v, "<u4").tobytes() for v in ids], sp.decode(ids, num_threads=1), keep_ids)

    return docs.mapInArrow(run, RESULT + KEPT * keep_ids)


def encode_decode(docs: DataFrame, model: str, keep_ids: bool = False, block_chunks: int = 262_144, table_limit: int = 1_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document, with `ids` and `decoded` too if keep_ids.

    ids_sha256 is of the ids as little-endian unsigned 32-bit numbers, decoded_sha256 of the decoded text in UTF-8.
    """
    chosen = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text"))
    if not segmenter(model).splits:
        return whole_texts(chosen, model, keep_ids)
    parts = PARTS * wide(docs.sparkSession)
    lists = block_rows(chosen, parts, True, block_chunks)
    texts = block_rows(chosen, parts, False, block_chunks)
    return joined(table_ids(lists, model, parts, table_limit).unionByName(texts), model, parts, keep_ids)
