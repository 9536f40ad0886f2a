import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.operators import bm25, chunk, context, dedup, evaluate, fusion, hybrid, pages, vector, versions
from corpuslake.operators.chunk import GroupTooLong, by_heading, by_size

# ---------------------------------------------------------------- chunking


def test_short_text_stays_whole():
    assert by_size("  one\n\n\ntwo  ", 50, 10) == ["one\n\n\ntwo"]
    assert by_size(" \n", 50, 10) == [] and by_size(None, 50, 10) == []


def test_overlap_and_glue_arithmetic():
    a, b, d = "a" * 300, "b" * 128, "c" * 512
    assert [len(x) for x in by_size("\n\n".join((a, b, d)), 512, 128)] == [430, 642]


def test_first_piece_too_long_gives_an_empty_chunk():
    assert by_size("x" * 40 + "\n\nshort", 30, 5) == ["", "x" * 40, "short"]


def test_long_paragraph_splits_at_lines_then_sentences():
    text = "一二三。四五六！" * 4 + "\n" + "y" * 10
    got = by_size(text, 12, 0)
    assert all(len(x) <= 12 for x in got) and "".join(got).replace("\n\n", "") == text.replace("\n", "")


@pytest.mark.parametrize("size, overlap", [(0, 0), (-1, 0), (100, 100), (100, 200)])
def test_bad_parameters(spark, size, overlap):
    with pytest.raises(ValueError):
        by_size("text", size, overlap)
    with pytest.raises(ValueError):
        chunk.chunk_by_heading(spark.createDataFrame([("a",)], "text string"), "text", size, overlap)


def test_headings():
    text = "# A\n\n" + "one " * 5 + "\n\n---\n\n## B\n\n" + "two " * 5
    assert by_heading(text, 40, 0) == [("# A\n\n" + ("one " * 5).strip(), "A"), ("## B\n\n" + ("two " * 5).strip(), "B")]
    assert by_heading("plain\n\nwords", 100, 0) == [("plain\n\nwords", "")]
    with pytest.raises(GroupTooLong):
        by_heading("# A\n\n" + "x" * 50 + "\n\n# B", 40, 0)


def test_headingless_text_is_packed():
    text = "\n\n".join("s%d " % i * 6 for i in range(12))
    got = by_heading(text, 50, 0)
    assert all(len(t) <= 50 and not h for t, h in got) and len(got) > 3


def test_chunk_frames(spark):
    df = spark.createDataFrame([(1, "p " * 40 + "\n\n" + "q " * 40, "s"), (2, None, "s"), (3, "# H\n\n" + "z" * 90, "s")], "doc_id int, text string, source string")
    rows = chunk.with_chunk_ids(chunk.chunk_by_size(df, size=80, overlap=10)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.total_chunks) for r in rows if r.doc_id == 1] == [(1, 0, 2), (1, 1, 2)]
    assert len({r.chunk_id for r in rows}) == len(rows) and not [r for r in rows if r.doc_id == 2]
    marked = chunk.chunk_by_heading(df, size=80, overlap=10).filter("doc_id = 3").collect()
    assert len(marked) == 1 and marked[0].document is None and "over 80" in marked[0].error


# ---------------------------------------------------------------- pages


def test_page_operators(spark):
    p = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, "bbbb"), ("d", 3, "cccc")], "doc string, page int, text string")
    assert [(r.start, r.end) for r in pages.page_offsets(p).orderBy("page").collect()] == [(0, 4), (6, 10), (12, 16)]
    chunks = spark.createDataFrame([("d", 0, "aaaa\n\nbb"), ("d", 1, "cc"), ("d", 2, "missing")], "doc string, chunk_index int, document string")
    got = pages.chunk_pages(chunks, pages.whole_text(p), pages.page_offsets(p)).orderBy("chunk_index").collect()
    assert [(r.page_start, r.page_end) for r in got] == [(1, 2), (3, 3), (1, 2)]


def test_headers_go(spark):
    rows = [("d", p, i, y, 100.0, t) for p in (1, 2, 3) for i, (y, t) in enumerate([(5.0, "HEAD "), (50.0, "HEAD of body"), (96.0, f"{p}")])]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, y double, height double, text string")
    found = pages.headers_footers(lines)
    assert [(r.zone, r.text, r.n) for r in found.collect()] == [("header", "HEAD", 3)]
    assert pages.remove_headers_footers(lines, found).count() == 6


# ---------------------------------------------------------------- dedup


def greedy(marks, t):
    kept = []
    for k, m in sorted(marks):
        if all(bin((m ^ x) & (2**64 - 1)).count("1") > t for _, x in kept):
            kept.append((k, m))
    return sorted(k for k, _ in kept)


@pytest.mark.parametrize("threshold", [0, 3, 5])
def test_first_of_each_is_the_greedy_pass(spark, threshold):
    rng = random.Random(threshold)
    marks = []
    for i in range(120):
        base = marks[rng.randrange(len(marks))][1] if marks and rng.random() < 0.7 else rng.getrandbits(64)
        m = base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) if marks else base
        m &= 2**64 - 1
        marks.append((i, m - 2**64 if m >= 2**63 else m))
    df = spark.createDataFrame(marks, "doc int, simhash bigint")
    got = sorted(r.doc for r in dedup.first_of_each(df, threshold).collect())
    assert got == greedy(marks, threshold)
    near = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1") <= threshold
    first = {}
    for i, m in marks:
        first.setdefault(m, i)
    members, links = dedup.near_links(df, threshold)
    assert {(r.doc, r.class_id) for r in members.collect()} == {(i, first[m]) for i, m in marks}
    assert {(r.a, r.b) for r in links.collect()} == {(i, j) for x, i in first.items() for y, j in first.items() if i < j and near(x, y)}
    counts = {r.doc: r.n_links for r in dedup.link_counts(df, threshold).collect()}
    assert counts == {i: sum(near(m, x) for x in first if x != m) for i, m in marks}


def test_history_and_blank(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, " ", 0), (3, "b", 7 << 40), (4, "c", 8)], "doc int, document string, simhash bigint")
    old = spark.createDataFrame([(6,)], "simhash bigint")
    assert [r.doc for r in dedup.filter_chunks(df, history=old).collect()] == [3]
    assert [r.doc for r in dedup.filter_chunks(df).orderBy("doc").collect()] == [1, 3, 4]


def test_dual_filter(spark):
    df = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (2, "b", 1 << 40 | 1 << 41 | 1 << 42 | 1 << 43, [0.0, 1.0]), (3, "c", 1, [0.5, 0.5])], "doc int, document string, simhash bigint, embedding array<float>")
    store = spark.createDataFrame([(9, [0.0, 2.0])], "doc int, embedding array<float>")
    kept, counts = dedup.dual_filter(df, store)
    assert [r.doc for r in kept.collect()] == [1]
    assert tuple(counts.first()) == (3, 1, 1)


# ---------------------------------------------------------------- retrieval


def test_bm25_scores(spark):
    docs = ["a b b c", "b c d", "x y", "", "a a a a"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc bigint, document string")
    asked = spark.createDataFrame([(0, "b a b"), (1, "nothing"), (2, "")], "query_id bigint, question string")
    got = [(r.query_id, r.doc, r.score, r["rank"]) for r in bm25.search(bm25.build_index(df), asked, 3).orderBy("query_id", "rank").collect()]
    split = [d.split() for d in docs]
    avg = sum(map(len, split)) / 5
    want = {}
    for t in ("a", "b"):
        n = sum(t in d for d in split)
        for i, d in enumerate(split):
            if t in d:
                want[i] = want.get(i, 0) + math.log(1 + (5 - n + 0.5) / (n + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
    order = sorted(want, key=lambda i: (-round(want[i], 4), i))
    assert got == [(0, i, round(want[i], 4), k) for k, i in enumerate(order[:3], 1)]


def test_blocks_give_what_all_postings_give(spark, tmp_path):
    """A written index, appended to, against a search of all postings; documents on one subject stand together."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randint(0, 40)) + rng.choices([f"s{i // 150}"], k=rng.randint(0, 6)))) for i in range(1500)]
    rows += [(1500, ""), (1501, None)]
    df = spark.createDataFrame(rows, "doc bigint, document string")
    asked = spark.createDataFrame([(q, f"c{q} s{q % 10} s{q % 10}") for q in range(12)] + [(12, "c1 c2 c3"), (13, "nothing"), (14, ""), (15, None)], "query_id bigint, question string")
    path = str(tmp_path / "index")
    bm25.build_index(df.filter("doc < 700 AND doc <> 350")).write(path)
    bm25.build_index(df.filter("doc >= 700 OR doc = 350")).append(path)  # block 2 gets a second row a token
    stored, whole = bm25.Index.read(spark, path), bm25.build_index(df)
    assert stored.stats.first() == whole.stats.first()
    assert sorted(map(tuple, stored.postings.collect())) == sorted(map(tuple, whole.postings.collect()))
    for k in (1, 10, 2000):
        assert sorted(map(tuple, bm25.search(stored, asked, k).collect())) == sorted(map(tuple, bm25.search(whole, asked, k).collect()))
    read = {r.query_id: (r.postings, r.read) for r in bm25.postings_read(stored, asked, 10).collect()}
    assert sorted(read) == list(range(13)) and sum(r for _, r in read.values()) < 0.7 * sum(p for p, _ in read.values())
    assert bm25.search(bm25.Index.read(spark, path), asked, 5, k1=-0.5).count()  # no bound holds: all postings


def test_cells_give_what_all_rows_give(spark, tmp_path):
    """Clusters of vectors, repeated, zero, null and odd ones, and two more lengths."""
    rng = random.Random(8)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in middles[i % 40]]) for i in range(3000)]
    rows += [(3000 + i, rows[i][1]) for i in range(50)] + [(4000, [0.0] * 16), (4001, None), (4002, [1.0, None]), (4003, [])]
    rows += [(5000 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)] + [(6000, [1.0, 2.0])]
    store = spark.createDataFrame(rows, "doc bigint, embedding array<double>")
    asked = [(i, rows[i][1]) for i in (0, 1, 2, 45, 3050, 3051, 3054)] + [(90, [-x for x in rows[3][1]]), (91, [3.0, 4.0]), (92, [1.0, 1.0, 1.0]), (93, [1.0] * 9), (94, None)]
    asked = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    vector.Cells.write(store, str(tmp_path))
    cells = vector.Cells.read(spark, str(tmp_path))
    for k in (1, 7, 100):
        got = sorted(map(tuple, vector.nearest_by_cells(cells, asked, k).collect()))
        assert got == sorted(map(tuple, vector.nearest(store, asked, k).collect()))
    near = asked.filter("query_id < 4 OR query_id = 45")
    found = vector.CellSearch(cells, near, 5)
    assert found.first.count() + found.rest.count() < 0.3 * 5 * cells.centres.filter("size = 16").count()
    got = vector.nearest_by_cells(cells, near, 100, threshold=0.9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, vector.nearest(store, near, 100, threshold=0.9).collect()))
    assert vector.nearest_by_cells(cells, asked.limit(0), 3).count() == 0


def test_an_empty_index_is_written_and_read(spark, tmp_path):
    none = spark.createDataFrame([], "doc bigint, document string")
    bm25.build_index(none).write(str(tmp_path / "index"))
    stored = bm25.Index.read(spark, str(tmp_path / "index"))
    assert bm25.search(stored, spark.createDataFrame([(1, "a")], "query_id bigint, question string")).count() == 0
    assert stored.stats.first()["n"] == 0


def test_vector_search_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    store = spark.createDataFrame(rows, "doc bigint, embedding array<double>")
    asked = spark.createDataFrame(rows[:7], "query_id bigint, vector array<double>")
    got = {}
    for r in vector.nearest(store, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc, r.score))
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1
    for q, v in rows[:7]:
        s = [(i, max(0.0, min(1.0, round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 4)))) for i, w in rows]
        assert got[q] == sorted(s, key=lambda x: (-x[1], x[0]))[:4]
    assert vector.nearest(store, asked.limit(0), 4).count() == 0


def test_select_hits(spark):
    hits = spark.createDataFrame([(1, d, s, r) for d, s, r in (("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.1, 3))], "query_id int, document string, score double, rank int")
    pick = lambda **k: [r.document for r in hybrid.select_hits(hits, 2, **k).orderBy("rank").collect()]
    assert pick(threshold=0.3) == ["a", "b"] and pick(threshold=0.3, backfill=False) == ["a"] and pick() == ["a", "b"]


def test_fusion_of_one_empty_list(spark):
    kw = spark.createDataFrame([(1, 4, 2.0, 1)], "query_id int, doc int, score double, rank int")
    assert [(r.doc, r.score) for r in fusion.reciprocal_rank(kw, kw.limit(0)).collect()] == [(4, round(1 / 61, 6))]
    assert [(r.doc, r.score) for r in fusion.linear(kw.limit(0), kw).collect()] == [(4, 0.0)]


# ---------------------------------------------------------------- contexts, versions, evaluation


@pytest.mark.parametrize("sizes, want", [([10, 10], [10, 10]), ([2800], [2730]), ([2000, 900], [2000, 723]), ([2600, 200], [2600, 123]), ([2650, 200], [2650]), ([2000, 900, 5], [2000, 723])])
def test_trimming(spark, sizes, want):
    rows = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes, 1)], "query_id int, rank int, part string")
    for got in (context.trim(rows), context.pack(rows).select("query_id", context.trim_text(F.col("context")).alias("context"))):
        assert [len(p) for p in got.first()["context"].split(context.SEPARATOR)] == want


def test_version_deltas_and_rollback(spark):
    events = spark.createDataFrame([("d", "f", 10, 1), ("d", "f", 15, 2), ("d", "f", 7, 3)], "doc_id string, file_name string, chunk_count int, seq int")
    log = versions.version_log(events)
    assert [(r.version, r.delta) for r in log.orderBy("version").collect()] == [(1, 10), (2, 5), (3, -8)]
    for target, done, active in ((2, True, 2), (0, False, 3), (99, False, 3)):
        wanted = spark.createDataFrame([("d", target, 9)], "doc_id string, target int, seq int")
        assert versions.rollbacks(log, wanted).first()["done"] is done
        assert versions.active_versions(versions.pointers(log, wanted)).first()["active_version"] == active
    unknown = spark.createDataFrame([("u",)], "doc_id string")
    assert versions.active_versions(versions.pointers(log), unknown).first()["active_version"] == 0


def test_recall(spark):
    data = spark.createDataFrame([(1, "q1", ["needle"]), (2, "q2", ["b c"]), (3, "q3", ["zzz"]), (4, "", ["x"]), (5, "q5", [])], "query_id int, question string, relevant_texts array<string>")
    hits = spark.createDataFrame([(1, 1, "a needle"), (2, 1, "a b"), (2, 2, "c d"), (3, 1, "other")], "query_id int, rank int, document string")
    details = evaluate.question_hits(data, hits, 5)
    assert {r.query_id: r.first_rank for r in details.collect()} == {1: 1, 2: 2, 3: -1}
    assert tuple(evaluate.recall_summary(details).first()) == (3, 2, 0.3333, 0.6667, 0.6667, 0.5)
    assert [(r.query_id, r.snippet) for r in evaluate.misses(details).collect()] == [(3, "other")]
    short = evaluate.question_hits(data, hits, 2)
    assert tuple(evaluate.recall_summary(short, 2).first())[2:5] == (0.3333, 0.0, 0.0)
    assert tuple(evaluate.recall_summary(details.limit(0)).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_null_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.9, 0.1]), (6, [])]
    store = spark.createDataFrame(rows, "doc bigint, embedding array<float>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 0.0, 2.0])], "query_id bigint, vector array<float>")
    got = [(r.query_id, r.doc) for r in vector.nearest(store, asked, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1), (0, 5), (3, 4)]
    assert {(r.query_id, r.doc) for r in vector.vector_duplicates(asked, store, 0.9).collect()} == {(0, 1)}
    assert vector.vector_duplicates(asked, store.limit(0), 0.9).count() == 0 and vector.vector_duplicates(asked.limit(0), store, 0.9).count() == 0


@pytest.mark.parametrize("pivots, group", [(4, 10), (64, 20_000)])
def test_vector_duplicates_equal_all_pairs(spark, monkeypatch, pivots, group):
    monkeypatch.setattr(vector, "PIVOTS", pivots)
    monkeypatch.setattr(vector, "GROUP_ROWS", group)
    monkeypatch.setattr(vector, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 6))
    near = base[rng.integers(0, 300, 200)] + rng.normal(size=(200, 6)) * rng.choice([0.0, 0.02, 0.2, 1.0], (200, 1))
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "doc bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "query_id bigint, vector array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.floor(np.abs(unit(near) @ unit(base).T) * 10_000 + 0.5) / 10_000 * np.sign(unit(near) @ unit(base).T)
    want = {(i, int(s.argmax()), float(s.max())) for i, s in enumerate(score) if s.max() >= 0.95}
    got = {(r.query_id, r.doc, r.score) for r in vector.vector_duplicates(asked, store, 0.95).collect()}
    assert len(want) > 100 and got == want


def test_vector_duplicates_of_mixed_lengths_equal_all_pairs(spark, monkeypatch):
    """A few vectors of rare lengths beside many; lengths with a sample of their own and lengths without."""
    monkeypatch.setattr(vector, "PIVOTS", 16)
    monkeypatch.setattr(vector, "LENGTHS", 2)
    rng = np.random.default_rng(9)
    sizes = [3] * 4000 + [5] * 400 + [4] * 5 + [7] * 3
    base = [rng.normal(size=n) for n in sizes]
    near = [base[i] + rng.normal(size=sizes[i]) * rng.choice([0.0, 0.05]) for i in [*rng.integers(0, 4400, 120), *range(4400, 4408)]]
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "doc bigint, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)] + [(900, [1.0, 2.0])], "query_id bigint, vector array<double>")
    want = set()
    for i, v in enumerate(near):
        scores = [(float(np.floor(np.dot(v, b) / np.linalg.norm(v) / np.linalg.norm(b) * 10_000 + 0.5) / 10_000), -d) for d, b in enumerate(base) if len(b) == len(v)]
        top, d = max(scores)
        if top >= 0.98:
            want.add((i, -d, min(top, 1.0)))
    got = {(r.query_id, r.doc, r.score) for r in vector.vector_duplicates(asked, store, 0.98).collect()}
    assert got == want and {i for i, _, _ in want} >= set(range(120, 128))
