import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.llm import tiff

SCHEMES = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS]


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_schemes_round_trip(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_beyond_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes() + b"ab" * 30_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


@pytest.mark.parametrize("scheme", SCHEMES)
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("kind, shape", [(np.uint8, (37, 21)), (np.uint8, (5, 50, 3)), (np.uint16, (33, 18))])
def test_pages_round_trip(scheme, tile, kind, shape):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 4, shape).astype(kind) * 50 for _ in range(3)]
    for predictor in (1, 2):
        for big in (False, True):
            data = tiff.build(images, scheme=scheme, predictor=predictor, rows=8, tile=tile, big_endian=big)
            got = list(tiff.pages(data))
            assert len(got) == 3
            for a, b in zip(images, got):
                assert (b.reshape(a.shape) == a).all()


def test_read_pages_one_row_each(spark):
    three = tiff.build([np.full((2, 3), i, np.uint8) for i in range(3)])
    ring = bytearray(tiff.build([np.zeros((1, 1), np.uint8)]))
    ring[-4:] = ring[4:8]
    df = spark.createDataFrame([(1, three, "x"), (2, None, "x"), (3, b"no tiff", "x"), (4, bytes(ring), "x"), (5, b"", "x")], "doc_id bigint, media binary, page string")
    rows = sorted(tiff.read_pages(df, "doc_id").collect(), key=lambda r: (r.doc_id, r.page if r.page is not None else 99))
    assert [(r.doc_id, r.page, r.width, r.height) for r in rows if r.doc_id == 1] == [(1, 0, 3, 2), (1, 1, 3, 2), (1, 2, 3, 2)]
    assert [bytes(r.pixels)[0] for r in rows if r.doc_id == 1] == [0, 1, 2]
    assert not [r for r in rows if r.doc_id == 2]
    assert all(any(r.error for r in rows if r.doc_id == i) for i in (3, 4, 5))


def test_texts_come_back(spark):
    texts = [None, "", "a", "x" * 64, "é日本" * 5000, "\x00", "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id bigint, text string, media string")
    got = {r.doc_id: r for r in tiff.digests(tiff.store_texts(df)).collect()}
    assert len(got) == 9
    for i, t in [*enumerate(texts), (None, "null id")]:
        raw = (t or "").encode()
        pad = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert got[6][2:] == got[7][2:]
    assert tiff.digests(tiff.store_texts(df.limit(0))).count() == 0


def header(tags, blocks=(), order="<"):
    """A one-page file from raw tags {tag: (type, values)}; the places of blocks go into STRIP_AT."""
    out, at = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)), []
    for b in blocks:
        at.append(len(out))
        out += b
    if blocks:
        tags = tags | {tiff.STRIP_AT: (4, at), tiff.STRIP_SIZE: (4, [len(b) for b in blocks])}
    entries = bytearray()
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{tiff.TYPE_CODE[kind]}", *values)
        if len(raw) > 4:
            place = len(out)
            out += raw
            raw = struct.pack(order + "I", place)
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0))


def base(width, height, bits=8, **more):
    names = {"samples": (tiff.SAMPLES, 3), "planar": (tiff.PLANAR, 3), "predictor": (tiff.PREDICTOR, 3), "rows": (tiff.ROWS, 4), "form": (tiff.SAMPLE_FORMAT, 3), "fill": (tiff.FILL_ORDER, 3)}
    return {tiff.WIDTH: (4, [width]), tiff.HEIGHT: (4, [height]), tiff.BITS: (3, [bits]), **{names[k][0]: (names[k][1], [v]) for k, v in more.items()}}


def test_small_samples_planes_and_floats():
    rng = np.random.default_rng(4)
    for bits in (1, 2, 4):
        a = rng.integers(0, 1 << bits, (5, 11)).astype(np.uint8)
        lines = np.unpackbits(a[:, :, None], axis=2)[:, :, 8 - bits :].reshape(5, -1)
        (got,) = tiff.pages(header(base(11, 5, bits), [np.packbits(lines, axis=1).tobytes()]))
        assert (got[:, :, 0] == a).all()
    planes = rng.integers(0, 255, (3, 6, 7)).astype(np.uint8)
    strips = [p[y : y + 4].tobytes() for p in planes for y in (0, 4)]
    (got,) = tiff.pages(header(base(7, 6, 8, samples=3, planar=2, rows=4), strips))
    assert (got == planes.transpose(1, 2, 0)).all()
    for order in "<>":
        wide = rng.integers(0, 2**32, (4, 9), np.uint64).astype(np.uint32)
        diff = np.concatenate((wide[:, :1], np.diff(wide, axis=1).astype(np.uint32)), axis=1)
        (got,) = tiff.pages(header(base(9, 4, 32, predictor=2), [diff.astype(np.dtype(np.uint32).newbyteorder(order)).tobytes()], order))
        assert (got[:, :, 0] == wide).all()
    for samples in (1, 2):
        f = rng.normal(size=(4, 9, samples)).astype(np.float32)
        rows = f.astype(">f4").reshape(4, -1).view(np.uint8).reshape(4, -1, 4).transpose(0, 2, 1).reshape(4, -1, samples)
        rows = np.concatenate((rows[:, :1], np.diff(rows.astype(np.int16), axis=1).astype(np.uint8)), axis=1)
        (got,) = tiff.pages(header(base(9, 4, 32, predictor=3, form=3, samples=samples), [rows.tobytes()]))
        assert (got == f).all()


def test_any_broken_file_makes_an_error_row(spark):
    ok = tiff.build([np.arange(64, dtype=np.uint8).reshape(8, 8)], rows=4)
    files = [
        header(base(0, 4), [b"x"]),
        header(base(4, 0), [b"x"]),
        header(base(4, 4, samples=0), [b"x"]),
        header(base(2**32 - 1, 2**32 - 1), [b"x"]),
        header(base(4, 4, rows=0), [b"x" * 16]),
        header(base(4, 4, rows=2), [b"x" * 8]),
        header(base(4, 4), [b"x" * 8, b"x" * 8, b"x" * 8]),
        header(base(4, 4, bits=12), [b"x" * 24]),
        header(base(4, 4, fill=2), [b"x" * 16]),
        header(base(4, 4, predictor=9), [b"x" * 16]),
        header(base(4, 4, predictor=3), [b"x" * 16]),
        header(base(4, 4, bits=1, predictor=2), [b"x" * 16]),
        header(base(4, 4) | {tiff.TILE_AT: (4, [8]), tiff.TILE_SIZE: (4, [9]), tiff.TILE_W: (4, [0]), tiff.TILE_H: (4, [16])}),
        header(base(4, 4)),
        ok[: len(ok) // 2],
        ok[:9],
        ok[:4] + b"\xff\xff\xff\x7f" + ok[8:],
        b"II*\0",
    ]
    rng = np.random.default_rng(5)
    for _ in range(400):
        bad = bytearray(ok)
        for k in rng.integers(4, len(ok), 3):
            bad[k] = rng.integers(0, 256)
        files.append(bytes(bad))
    df = spark.createDataFrame(list(enumerate(files)), "doc_id int, media binary")
    rows = tiff.read_pages(df, "doc_id").collect()
    told = {r.doc_id for r in rows if r.error}
    assert set(range(18)) <= told and {r.doc_id for r in rows} == set(range(len(files)))


@given(st.binary(max_size=300), st.booleans())
@settings(max_examples=200, deadline=None)
def test_random_bytes_raise_known_errors_only(data, big):
    try:
        for _ in tiff.pages((b"MM\0*" if big else b"II*\0") + data):
            pass
    except (ValueError, KeyError, struct.error, zlib.error, IndexError, OverflowError, MemoryError):
        pass


def test_feature_and_stored_form_against_plain_counting(spark):
    texts = ["", "abc", "aaaa" * 100, "é日" * 300]
    got = {r.doc_id: r for r in tiff.digests(tiff.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()}
    for i, t in enumerate(texts):
        raw = t.encode()
        pad = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        media = tiff.build([np.frombuffer(pad, np.uint8).reshape(-1, 64)])
        mean = sum(pad) / len(pad)
        sd = max(sum(x * x for x in pad) / len(pad) - mean * mean, 0) ** 0.5
        top = [f"{k:02x}" for k, _ in sorted(Counter({k: pad.count(k) for k in range(256)}).items(), key=lambda x: (-x[1], x[0]))[:5]]
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert got[i].feature == f"64x{len(pad) // 64}:{mean:.2f}:{sd:.2f}:" + ".".join(top)


def test_a_broken_stored_file_has_null_digests_and_large_own_files_are_read(spark, ):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, "whole")], "doc_id bigint, text string")
    stored = tiff.store_texts(docs)
    rows = stored.collect()
    broken = spark.createDataFrame([(r.doc_id, r.n_bytes, r.media if r.doc_id == 2 else b"II*") for r in rows], stored.schema)
    got = {r.doc_id: r for r in tiff.digests(broken).collect()}
    assert got[1].payload_bytes is None and got[1].feature is None and got[1].n_bytes == 5000 and got[2].payload_bytes == 64
    media = next(bytes(r.media) for r in rows if r.doc_id == 1)
    with pytest.raises(ValueError):
        list(tiff.pages(media, 1000))
    assert next(tiff.pages(media, None)).size == 5056
