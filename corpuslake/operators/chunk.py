"""Chunking: texts to ordered chunks by size or by heading, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.operators.common import bounded

CONFIG = EngineConfig()
GLUE = "\n\n"
PARAGRAPHS = re.compile(r"\n{2,}")
SENTENCE_ENDS = re.compile(r"(?<=[。？！；])")
SENTENCE_OR_LINE_ENDS = re.compile(r"(?<=[。？！；\n])")
HEADING = re.compile(r"^#{1,6}\s+")
RULE = re.compile(r"^[-*_]{3,}\s*$")


@dataclass
class Packer:
    """Gathers pieces up to `limit` characters, with GLUE between them.

    With an overlap, a full chunk's last whole pieces that fit into it begin the next chunk, the chunk is emitted
    even if it is empty, and the glue before a new chunk's own first piece is counted with or without a prefix.
    """

    limit: int
    overlap: int | None = None
    done: list[tuple[str, str]] = field(default_factory=list)
    held: list[str] = field(default_factory=list)
    size: int = 0
    label: str = ""

    def add(self, piece: str, label: str = "") -> None:
        grown = self.size + len(piece) + (len(GLUE) if self.held else 0)
        if grown <= self.limit:
            self.held.append(piece)
            self.size = grown
            self.label = self.label or label
            return
        if self.held or self.overlap is not None:
            self.done.append((GLUE.join(self.held), self.label))
        self.held, self.size = self._tail(), 0
        if self.overlap is not None:
            self.size = max(sum(map(len, self.held)) + len(GLUE) * (len(self.held) - 1), 0) + len(GLUE)
        self.held.append(piece)
        self.size += len(piece)
        self.label = label

    def _tail(self) -> list[str]:
        room, at = self.overlap or 0, len(self.held)
        while at:
            room -= len(self.held[at - 1]) + (len(GLUE) if at < len(self.held) else 0)
            if room < 0:
                break
            at -= 1
        return self.held[at:]

    def finish(self) -> list[tuple[str, str]]:
        if self.held:
            self.done.append((GLUE.join(self.held), self.label))
        return self.done


def packed(pieces: Iterable[str], limit: int) -> list[str]:
    p = Packer(limit)
    for x in pieces:
        p.add(x)
    return [t for t, _ in p.finish()]


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"the chunk size must be positive, not {size}")
    if overlap >= size:
        raise ValueError(f"the overlap ({overlap}) must be less than the chunk size ({size})")


def filled(parts: Iterable[str]) -> Iterator[str]:
    return (s for p in parts if (s := p.strip()))


def long_paragraph(text: str, limit: int) -> list[str]:
    """A paragraph's lines, those too long at sentence ends, packed up to the limit; a longer piece stays whole."""
    pieces = (s for line in filled(text.split("\n")) for s in (filled(SENTENCE_ENDS.split(line)) if len(line) > limit else (line,)))
    return packed(pieces, limit) or [text]


def by_size(text: str | None, size: int, overlap: int) -> list[str]:
    if not text or not text.strip():
        return []
    check(size, overlap)
    paragraphs = list(filled(PARAGRAPHS.split(text)))
    if sum(map(len, paragraphs)) <= size:
        return [text.strip()]
    p = Packer(size, overlap)
    for para in paragraphs:
        for piece in long_paragraph(para, size) if len(para) > size else (para,):
            p.add(piece)
    return [t for t, _ in p.finish()]


class GroupTooLong(ValueError):
    """A heading's group of paragraphs doesn't fit into a chunk."""


def sentences(text: str, limit: int) -> list[str]:
    """Sentences joined by spaces up to the limit; the space isn't counted."""
    out: list[str] = []
    for s in filled(SENTENCE_OR_LINE_ENDS.split(text)):
        if out and len(out[-1]) + len(s) <= limit:
            out[-1] += " " + s
        else:
            out.append(s)
    return out or [text]


def heading_groups(segments: list[str], limit: int) -> list[str]:
    """Segments joined from each heading to the next; without any heading, packed by length."""
    groups: list[list[str]] = []
    for s in segments:
        if not groups or HEADING.match(s):
            groups.append([])
        groups[-1].append(s)
    joined = [GLUE.join(g) for g in groups]
    if not any(map(HEADING.match, segments)):
        joined = [x for g in joined for x in ([g] if len(g) <= limit else packed((y for p in filled(g.split(GLUE)) for y in (sentences(p, limit) if len(p) > limit else [p])), limit))]
    for g in joined:
        if len(g) > limit:
            raise GroupTooLong(f"a group of {len(g)} characters, over {limit}, begins with {g[:80]!r}")
    return joined


def chapter_of(group: str) -> str:
    first = group.split("\n", 1)[0].strip()
    m = HEADING.match(first)
    return first[m.end() :].strip() if m else ""


def by_heading(text: str | None, size: int, overlap: int) -> list[tuple[str, str]]:
    """(chunk, chapter) in order."""
    if not text or not text.strip():
        return []
    check(size, overlap)
    segments = [s for s in filled(PARAGRAPHS.split(text)) if not RULE.match(s)]
    if sum(map(len, segments)) <= size:
        whole = GLUE.join(segments).strip()
        return [(whole, chapter_of(whole))]
    p = Packer(size, overlap)
    for g in heading_groups(segments, size):
        p.add(g, chapter_of(g))
    return p.finish()


# ---------------------------------------------------------------- DataFrames


def chunk_by_size(docs: DataFrame, text: str = "text", size: int = CONFIG.chunk_size, overlap: int = CONFIG.chunk_overlap) -> DataFrame:
    """docs without the text, one row per chunk: document, chunk_index, total_chunks."""
    check(size, overlap)

    def split(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [pa.array([by_size(t.as_py(), size, overlap) for t in texts.slice(at, 128)], kind) for at in range(0, len(texts), 128)]  # few strings at once
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    chunks = F.arrow_udf(split, "array<string>")(F.col(text))
    return _exploded(bounded(docs).withColumn("_chunks", F.transform(chunks, lambda c: F.struct(c.alias("document")))), text)


def chunk_by_heading(docs: DataFrame, text: str = "text", size: int = CONFIG.chunk_size, overlap: int = CONFIG.chunk_overlap, strict: bool = False) -> DataFrame:
    """docs without the text, one row per chunk: document, chapter, chunk_index, total_chunks and error.

    A group that is too long fails the job if strict; else its text gives one row with `error` and no chunk.
    """
    check(size, overlap)
    keep = [c for c in docs.columns if c != text]
    kind = "array<struct<document:string,chapter:string,error:string>>"
    arrow = pa.list_(pa.struct([("document", pa.string()), ("chapter", pa.string()), ("error", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(len(keep)).to_pylist():
                try:
                    rows.append([{"document": c, "chapter": h, "error": None} for c, h in by_heading(t, size, overlap)])
                except GroupTooLong as e:
                    if strict:
                        raise
                    rows.append([{"document": None, "chapter": None, "error": str(e)}])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, arrow)], [*keep, "_chunks"])

    chosen = docs.select(*keep, text)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1]) + f"_chunks {kind}"
    return _exploded(bounded(chosen).mapInArrow(run, schema), text)


def _exploded(df: DataFrame, text: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (text, "_chunks")]
    out = df.select(*rest, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "_c"))
    return out.select(*rest, "_c.*", "chunk_index", "total_chunks")


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """A chunk_id that depends only on the document, its version and the chunk's number."""
    version = F.col("version").cast("string") if "version" in chunks.columns else F.lit("1")
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), version, F.col("chunk_index").cast("string")), 256))
