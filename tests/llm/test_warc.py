import base64
import glob
import gzip
import hashlib
import os

import pytest

from corpuslake.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, d int"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((x for x in groups[b] if x is not None), default=None)
        out.append((i, len(b), digest(b), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    path = f"file://{tmp_path}/a"
    warc.write_archives(df, path, **options)
    read = warc.read_archives(spark, path, keep_payload=True)
    return path, read.collect()


ROWS = [
    (1, "http://a/", "<p>é日本😀</p>" * 9000),
    (2, "http://b/", "same"),
    (3, None, "same"),
    (4, "http://c/\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (5, "http://d/", ""),
    (6, "http://e/", None),
    (7, "http://f/", "0\r\n\r\n5\r\nhello\r\n\r\n"),
    (8, "http://g/", "<p>é日本😀</p>" * 9000),
    (None, "http://h/", "null id"),
    (None, "http://i/", "same"),
    (9, "http://j/", "\x00\x7f" * 50),
]


@pytest.mark.parametrize("options", [{}, {"segment_bytes": 100, "chunk_bytes": 7, "records_per_file": 50}])
def test_round_trip(spark, tmp_path, options):
    rows = ROWS if not options else [(i, u, (h or "")[:3000] if h else h) for i, u, h in ROWS]
    path, got = run(spark, tmp_path, rows, **options)
    assert all(r.valid for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_shuffle_join_of_many_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, f"http://{i}/", "hot" if i % 3 else f"own {i}") for i in range(60)]
    _, got = run(spark, tmp_path, rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    _, got = run(spark, tmp_path, [(1, "u", "x" * 40000)] * 3)
    assert [(r.page_id, r.record_type, r.payload_bytes, r.valid) for r in got] == [(1, "response", 40000, True)] * 3
    (tmp_path / "e").mkdir()
    assert run(spark, tmp_path / "e", [])[1] == []


def test_a_lost_segment_is_told(spark, tmp_path):
    path, _ = run(spark, tmp_path, [(1, "u", "abc" * 2000)], segment_bytes=500, records_per_file=1)
    files = [f for f in sorted(glob.glob(f"{tmp_path}/a/part-*")) if os.path.getsize(f)]
    assert len(files) > 5 and all(open(f, "rb").read(8) == b"WARC/1.1" for f in files)
    os.remove(files[3])
    (row,) = warc.read_archives(spark, path).collect()
    assert not row.valid and row.payload_bytes is None


@pytest.mark.parametrize("body, want", [(b"5\r\nhello\r\n0\r\n\r\n", b"hello"), (b"5;x=y\r\nhello\r\n0\r\nT: v\r\n\r\n", b"hello"), (b"0\r\n\r\n", b""), (b"5\r\nhel", None), (b"z\r\n", None), (b"5\r\nhelloXX0\r\n\r\n", None), (b"", None)])
def test_chunk_framing(body, want):
    assert warc.unchunked(body) == want


def test_pieces_keep_characters_whole():
    data = "a日本語é😀".encode() * 50
    for size in (4, 5, 7, 64):
        ends = warc.cut_points(data, size)
        assert ends[-1] == len(data)
        for a, b in zip([0, *ends], ends):
            assert 0 < b - a <= size
            data[a:b].decode()


def simple(page, body, **fields):
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<r{page}>", "WARC-Page-ID": page, **fields}
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_broken_archives_make_rows_and_stop_no_job(spark, tmp_path):
    good = simple(1, b"one"), simple(2, b"two")
    no_length = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 7\r\n\r\nabc\r\n\r\n"
    cases = {
        "a": (b"".join(good), [(1, True), (2, True)]),
        "b": (good[0] + good[1][:-12], [(1, True), (2, False)]),
        "c": (no_length + good[1], [(7, False), (2, True)]),
        "d": (b"bytes before\r\n" + good[0], [(None, False), (1, True)]),
        "e": (gzip.compress(good[0]) + gzip.compress(good[1]), [(1, True), (2, True)]),
        "f": (gzip.compress(good[0]) + gzip.compress(good[1])[:-9], [(None, False), (1, True), (2, True)]),
        "g": (gzip.compress(good[0])[:30], [(None, False), (None, False)]),  # the member and what it begins
        "h": (good[0].replace(b"Length: 22", b"Length: x"), [(1, False)]),
        "i": (simple("no number", b"x") + simple(3, b"y", **{"WARC-Segment-Number": "one"}), [(None, True), (3, False)]),
        "j": (simple(4, b"z", **{"WARC-Payload-Digest": "sha1:WRONG"}) + b"\x1f\x8b", [(4, False), (None, False)]),
        "k": (b"no archive at all", [(None, False)]),
        "l": (simple(5, b"r", **{"WARC-Type": "revisit", "WARC-Refers-To-Page-ID": "?"}), [(5, True)]),
        "m": (simple(6, b"s", **{"WARC-Segment-Number": 1}), [(6, False)]),
    }
    for name, (data, want) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(data)
        got = warc.read_archives(spark, f"file://{tmp_path}/{name}", pattern="*.warc").collect()
        assert sorted(((r.page_id, r.valid) for r in got), key=str) == sorted(want, key=str), name


def test_many_gzip_members():
    data = b"".join(gzip.compress(simple(i, b"x" * i)) for i in range(300))
    pieces, sound = warc.unpacked(data)
    assert sound and len(pieces) == 1 and len(list(warc.parse_records(pieces[0]))) == 300


def test_records_behind_a_damaged_gzip_member_are_read(spark, tmp_path):
    members = [gzip.compress(simple(i, os.urandom(3000))) for i in range(5)]
    for broken in (1, 3):
        member = bytearray(members[broken])
        member[200:300] = bytes(100)
        data = b"".join(bytes(member) if i == broken else m for i, m in enumerate(members))
        folder = tmp_path / str(broken)
        folder.mkdir()
        (folder / "x.warc.gz").write_bytes(data)
        got = warc.read_archives(spark, f"file://{folder}", pattern="*.gz").collect()
        assert sorted(r.page_id for r in got if r.valid) == [i for i in range(5) if i != broken]
        assert any(not r.valid for r in got)
