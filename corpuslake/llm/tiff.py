"""TIFF: a codec for media columns, with one row per page.

`pages` walks the chain of image directories of a file in either byte order, decodes strips and tiles that are
stored plainly or by PackBits, LZW or deflate, undoes horizontal differencing (of whole numbers and of floats), and
yields each page's samples: of 1, 2, 4, 8, 16 or 32 bits, or floats of 32, chunky or in planes. Samples of less than a
byte come out a byte each. `build` writes such files of 8 or 16 bits; it is what the round trip and the tests use.

A null file has no pages; a broken or unknown one, or a page of no pixels or of over `limit` bytes, gives one row with
`error` set and no pixels behind the pages before it, so that one bad file doesn't stop a job; null payloads are stored
as empty ones; payloads of any length are stored whole, in slices of rows bounded in bytes; repeated rows and ties give
equal rows; an empty table gives an empty result; only the named columns are carried.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import slices, small_batches

#: Tags and compression schemes of TIFF 6.0.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE = 284, 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}

CLEAR, END = 256, 257

#: Decoded bytes of a page up to which it is read; a header may say anything.
MAX_PAGE = 1 << 30


# ---------------------------------------------------------------- schemes


def packbits_encode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("PackBits data ends early")
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the reader, one entry behind, widens one code early."""
    bits, held, out, width = 0, 0, bytearray(), 9

    def put(code: int) -> None:
        nonlocal bits, held
        held = (held << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
            held &= (1 << bits) - 1

    put(CLEAR)
    book: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    nxt, cur = 258, b""
    for i in range(len(data)):
        longer = cur + data[i : i + 1]
        if longer in book:
            cur = longer
            continue
        put(book[cur])
        book[longer] = nxt
        nxt += 1
        if nxt == 4094:
            put(CLEAR)
            book = {bytes((k,)): k for k in range(256)}
            nxt, width = 258, 9
        elif nxt == 1 << width and width < 12:
            width += 1
        cur = data[i : i + 1]
    if cur:
        put(book[cur])
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    book = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held = ((held << 8) | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = (held >> bits) & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            del book[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = book[code]
        else:
            if code < len(book):
                entry = book[code]
            elif code == len(book):
                entry = last + last[:1]
            else:
                raise ValueError("broken LZW code")
            book.append(last + entry[:1])
        out += entry
        last = entry
        if len(book) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    if len(out) < size:
        raise ValueError("LZW data ends early")
    return bytes(out[:size])


def _pack(data: bytes, scheme: int, level: int) -> bytes:
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, level)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[scheme](data)


def _unpack(data: bytes, scheme: int, size: int) -> bytes:
    if scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme == NONE:
        out = bytes(data[:size])
    else:
        raise ValueError(f"compression {scheme} isn't known")
    if len(out) < size:
        raise ValueError("a strip or tile ends early")
    return out


# ---------------------------------------------------------------- files


def build(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, rows: int = 1024, tile: tuple[int, int] | None = None, big_endian: bool = False, level: int = 1) -> bytes:
    """A TIFF of 8- or 16-bit images (height, width) or (height, width, samples), each a page.

    tile: (width, height), multiples of 16; else strips of `rows` rows.
    """
    order = ">" if big_endian else "<"
    out = bytearray(struct.pack(order + "2sHI", b"MM" if big_endian else b"II", 42, 0))
    link = 4
    for image in images:
        a = np.asarray(image)
        a = a[:, :, None] if a.ndim == 2 else a
        height, width, samples = a.shape
        blocks = []
        if tile:
            tw, th = tile
            padded = np.zeros((-(-height // th) * th, -(-width // tw) * tw, samples), a.dtype)
            padded[:height, :width] = a
            parts = [padded[y : y + th, x : x + tw] for y in range(0, padded.shape[0], th) for x in range(0, padded.shape[1], tw)]
        else:
            parts = [a[y : y + rows] for y in range(0, height, rows)]
        for part in parts:
            if predictor == 2:
                part = np.concatenate((part[:, :1], part[:, 1:] - part[:, :-1]), axis=1)
            blocks.append(_pack(part.astype(a.dtype.newbyteorder(order)).tobytes(), scheme, level))
        at = []
        for b in blocks:
            out += b"\0" * (len(out) % 2)
            at.append(len(out))
            out += b
        sizes = [len(b) for b in blocks]
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * a.dtype.itemsize] * samples), (COMPRESSION, 3, [scheme]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        if tile:
            tags += [(SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), (TILE_W, 4, [tile[0]]), (TILE_H, 4, [tile[1]]), (TILE_AT, 4, at), (TILE_SIZE, 4, sizes)]
        else:
            tags += [(STRIP_AT, 4, at), (SAMPLES, 3, [samples]), (ROWS, 4, [rows]), (STRIP_SIZE, 4, sizes), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        out += b"\0" * (len(out) % 2)
        entries = bytearray()
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPE_CODE:
            continue
        place = at + 10 + 12 * i
        if TYPE_SIZE[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _kind(tags: dict[int, tuple]) -> tuple[int, np.dtype]:
    """Bits of a sample and the type it is read as."""
    bits, form = set(tags.get(BITS, (1,))), set(tags.get(SAMPLE_FORMAT, (1,)))
    found = {1: np.uint8, 2: np.uint8, 4: np.uint8, 8: np.uint8, 16: np.uint16, 32: np.float32 if form == {3} else np.uint32}
    if len(bits) != 1 or not bits <= found.keys() or (form == {3} and bits != {32}) or len(form) != 1:
        raise ValueError("samples of these bits aren't read")
    return bits.pop(), np.dtype(found[min(set(tags.get(BITS, (1,))))])


def _block(raw: bytes, rows: int, width: int, samples: int, bits: int, kind: np.dtype, predictor: int, order: str) -> np.ndarray:
    """The samples of a decoded strip or tile."""
    if bits < 8:
        row = -(-width * samples * bits // 8)
        lines = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row), axis=1)[:, : width * samples * bits]
        return np.packbits(lines.reshape(-1, bits), axis=1).reshape(rows, width, samples) >> (8 - bits)
    if predictor == 3:  # bytes differenced along the row, the most significant ones of all samples first
        sums = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * samples)
        return np.ascontiguousarray(sums.transpose(0, 2, 1)).view(kind.newbyteorder(">")).astype(kind).reshape(rows, width, samples)
    part = np.frombuffer(raw, kind.newbyteorder(order)).astype(kind).reshape(rows, width, samples)
    return np.cumsum(part, axis=1, dtype=kind) if predictor == 2 else part


def _samples(data: bytes, tags: dict[int, tuple], order: str, limit: int | None) -> np.ndarray:
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    scheme, predictor, planes = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0], tags.get(PLANAR, (1,))[0]
    bits, kind = _kind(tags)
    if predictor not in (1, 2, 3) or (predictor == 3) != (kind == np.float32 and predictor != 1) or (predictor == 2 and bits < 8) or planes not in (1, 2) or tags.get(FILL_ORDER, (1,))[0] != 1:
        raise ValueError("this predictor, planar configuration or fill order isn't read")
    tiled = TILE_AT in tags
    bw = tags[TILE_W][0] if tiled else width
    bh = tags[TILE_H][0] if tiled else min(tags.get(ROWS, (height,))[0], height)
    if min(width, height, samples, bw, bh) < 1:
        raise ValueError("a page of no pixels")
    if limit is not None and max(width, bw) * max(height, bh) * samples * kind.itemsize > limit:
        raise ValueError("a page of too many pixels")
    across, down = -(-width // bw), -(-height // bh)
    each = samples if planes == 1 else 1
    places = list(zip(tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZE if tiled else STRIP_SIZE], strict=True))
    if len(places) != across * down * (samples // each):
        raise ValueError("strips or tiles are missing")
    page = np.zeros((height, width, samples), kind)
    for i, (at, size) in enumerate(places):
        plane, i = divmod(i, across * down)
        y, x = (i // across) * bh, (i % across) * bw
        rows = bh if tiled else min(bh, height - y)
        raw = _unpack(data[at : at + size], scheme, rows * -(-bw * each * bits // 8))
        part = _block(raw, rows, bw, each, bits, kind, predictor, order)
        page[y : y + rows, x : x + bw, plane : plane + each] = part[: height - y, : width - x]
    return page


def pages(data: bytes, limit: int | None = MAX_PAGE) -> Iterator[np.ndarray]:
    """The samples (height, width, samples) of each page in the order of the directories; limit bounds a page's decoded bytes."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a ring")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _samples(data, tags, order, limit)


# ---------------------------------------------------------------- columns

PAGE = "page int, width int, height int, samples int, pixels binary, error string"


def read_pages(files: DataFrame, id_col: str, media_col: str = "media", extra: tuple[str, ...] = (), limit: int | None = MAX_PAGE) -> DataFrame:
    """One row per page of each file: the id, `extra` columns, then page, width, height, samples, pixels and error.

    limit: decoded bytes of a page; None for files whose headers are trusted.
    """
    carried = [id_col, *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, len(carried), 128):
                rows, source = [], []
                for i, media in enumerate(part.column(len(carried)).to_pylist()):
                    try:
                        for no, a in enumerate(pages(media, limit) if media is not None else ()):
                            rows.append((no, a.shape[1], a.shape[0], a.shape[2], a.tobytes(), None))
                            source.append(i)
                    except (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
                        rows.append((None, None, None, None, None, str(e)[:200] or "broken"))
                        source.append(i)
                if rows:
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                    made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    kept = [part.column(i).take(pa.array(source, pa.int32())) for i in range(len(carried))]
                    yield pa.RecordBatch.from_arrays([*kept, *made], [*carried, *(x.split()[0] for x in PAGE.split(", "))])

    chosen = files.select(*carried, media_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, {PAGE}")


def payload_of(text: bytes | None, unit: int = 64) -> bytes:
    raw = text or b""
    return raw + b"\0" * ((-len(raw)) % unit if raw else unit)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text, padded with zero bytes to whole rows of `width`, as a one-page TIFF of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 128):
                texts = part.column(1).to_pylist()
                media = [build([np.frombuffer(payload_of(t, width), np.uint8).reshape(-1, width)]) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return small_batches(docs).select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"{id_col} bigint, n_bytes bigint, media binary")


def feature(pixels: bytes, width: int, height: int) -> str:
    """Size, rounded mean and deviation of the samples, and the five commonest samples."""
    a = np.frombuffer(pixels, np.uint8)
    counts = np.bincount(a, minlength=256)
    top = np.lexsort((np.arange(256), -counts))[:5]
    mean = int((counts * np.arange(256)).sum()) / max(len(a), 1)
    square = int((counts * np.arange(256) ** 2).sum()) / max(len(a), 1)
    return f"{width}x{height}:{mean:.2f}:{max(square - mean * mean, 0) ** 0.5:.2f}:" + ".".join(f"{i:02x}" for i in top)


def digests(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored text: what is read back from its TIFF, as digests and a feature string; null for a file that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pixels, w, h in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                out.append((None,) * 4 if pixels is None else (len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-64:]), feature(pixels, w, h)))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.string(), pa.int64(), pa.string()])] if out else [pa.array([], k) for k in (pa.int64(), pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cols[0], cols[1], cols[2], b.column(5), b.column(6), cols[3]], NAMES)

    NAMES = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    sized = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    page = read_pages(sized, id_col, "media", ("n_bytes", "media_bytes", "media_sha256"), None)  # store_texts wrote the files
    chosen = page.select(id_col, "n_bytes", "pixels", "width", "height", "media_bytes", "media_sha256")
    return chosen.mapInArrow(run, f"{id_col} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
