"""What steps shuffle, hold or repeat as tables grow."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpuslake.functions.fingerprint import simhash_of
from corpuslake.operators import bm25, chunk, dedup, occurrences, pages, vector
from corpuslake.plans.catalogue import ORACLES, QUERIES


def test_a_search_shuffles_candidates_not_postings(spark):
    """Each task gives at most top_k rows a query, though every document has every query's tokens; ties go to the first documents."""
    df = spark.createDataFrame([(i, "a b " + "c " * (i % 5)) for i in range(3000, 0, -1)], "doc bigint, document string").repartition(4)
    said = [["a"], ["a", "b"], ["c"]]
    for written in (False, True):
        index = bm25.build_index(df, written=written)
        found = bm25._Search(index, said, 7, 1.5, 0.75).best()
        assert found.count() <= 7 * len(said) * found.rdd.getNumPartitions()
    asked = spark.createDataFrame([("x", "a")], "query_id string, question string")  # in all documents: scores are 0.0002 or 0.0001
    assert [r.doc for r in bm25.search(index, asked, 7).orderBy("rank").collect()] == [1, 2, 5, 6, 7, 10, 11]  # longer texts score 0.0001


def test_queries_are_taken_in_bounded_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(200)], "doc bigint, document string")
    asked = spark.createDataFrame([(q, " ".join(rng.choices(words, k=3))) for q in range(25)], "query_id int, question string")
    index = bm25.build_index(df)
    want = sorted(map(tuple, bm25.search(index, asked, 5).collect()))
    monkeypatch.setattr(bm25, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(bm25, "BLOCK_PAIRS", 20)
    assert sorted(map(tuple, bm25.search(index, asked, 5).collect())) == want


def test_chunkers_take_bounded_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(3).selectExpr("id AS doc_id", "'one two' AS text")
    for cut in (chunk.chunk_by_size, chunk.chunk_by_heading):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert cut(df).count() == 3
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2048


def test_small_documents_share_a_call(spark):
    """Pages of 400 documents in one Python call for each of few groups, with equal chunks, a missing document and null texts."""
    p = spark.createDataFrame([(d, n, f"text {d} {n} " * n) for d in range(400) for n in (1, 2, 3)] + [(400, 1, None), (None, 5, "loose text")], "doc int, page int, text string")
    chunks = spark.createDataFrame([(d, n, f"text {d} {n} ") for d in range(400) for n in (1, 2, 3)] + [(0, 4, "text 0 2 "), (7, 4, None), (999, 0, "x"), (None, 8, "text")], "doc int, chunk_index int, document string")
    found = pages.chunk_pages(chunks, pages.whole_text(p), pages.page_offsets(p))
    got = {(r.doc, r.chunk_index): (r.page_start, r.page_end) for r in found.collect()}
    assert got == {(d, n): (n, n) for d in range(400) for n in (1, 2, 3)} | {(0, 4): (2, 2), (7, 4): (1, 1), (None, 8): (1, 1)}
    assert "_group" in found._jdf.queryExecution().logical().toString()


def test_chunk_pages_makes_no_whole_text(spark, monkeypatch, tmp_path):
    """The query equals its SQL without joining a source's texts; with texts that are null, empty, equal, parts of others, or in no source."""
    def whole_text(_):
        raise AssertionError("a document's whole text is made")

    rng = random.Random(4)
    words = lambda n: " ".join(rng.choices(["alpha", "beta", "γ", "d"], k=n))
    texts = [words(rng.choice([1, 2, 5, 60, 400])) for _ in range(120)] + ["", "beta", "x" * 40_000 + words(3), "x" * 40_000]
    rows = [(i, rng.choice(texts), f"s{i % 4}") for i in range(300)] + [(300, None, "s0"), (301, None, "nulls"), (302, "alpha", None), (303, "", "empty")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(pages, "whole_text", whole_text)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["chunk_pages"]).fetchall()
    assert sorted(map(tuple, QUERIES["chunk_pages"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 303


@pytest.mark.parametrize("seed", range(3))
def test_chunks_on_pages_are_the_first_occurrences(spark, monkeypatch, seed):
    """Chunks over pages, cut or missing ones, and long ones in parts, in texts read by small blocks and stretches, against str.find."""
    rng = random.Random(seed)
    for name, values in (("LONGEST", (4, 16, 64)), ("BLOCK", (8, 64)), ("PAIRS", (3, 1000)), ("TOGETHER", (2, 4096))):
        monkeypatch.setattr(occurrences, name, rng.choice(values))
    stretch = rng.choice((70, 300))
    monkeypatch.setattr(occurrences, "STRETCH", stretch)
    monkeypatch.setattr(occurrences, "SHORT_STRETCH", stretch)
    monkeypatch.setattr(pages, "PLACES", rng.choice((8, 100)))
    word = lambda n: "".join(rng.choices(("ab", "αβ中😀 \n", "a")[seed], k=n))
    rows, chunks, want = [], [], {}
    for d in (*range(8), None):
        base = word(120)
        mine = [(p, rng.choice(["", word(rng.randint(1, 5)), word(rng.randint(0, 300)), base, base + word(3)])) for p in range(3, rng.randint(4, 12))]
        rows += [(d, *x) for x in mine]
        whole, begins = "\n\n".join(t for _, t in mine), [sum(len(t) + 2 for _, t in mine[:i]) for i in range(len(mine))]
        for i in range(20):
            a = rng.randrange(max(len(whole), 1))
            c = rng.choice([whole[a : a + rng.choice([1, 2, 3, 7, 60, 300])], whole[a : a + 55] + "zz", word(rng.randint(0, 70)), "", whole + "\n\n"])
            at = whole.find(c) if c in whole else max(whole.find(c[:50]), 0)
            before = [p for (p, _), b in zip(mine, begins) if b < at + len(c)]
            chunks.append((d, i, c))
            want[d, i] = next((p for (p, t), b in zip(mine, begins) if b <= at < b + len(t) + 2), 1), before[-1] if before else 1
    rng.shuffle(rows)
    found = pages.chunks_on_pages(spark.createDataFrame([*chunks, (99, 0, "a")], "doc int, chunk_index int, document string"), spark.createDataFrame(rows, "doc int, page int, text string"))
    assert {(r.doc, r.chunk_index): (r.page_start, r.page_end) for r in found.collect()} == want


def test_vectors_near_all_cells_are_given_in_bounded_batches():
    v = np.random.default_rng(1).normal(size=(9000, 4))
    rows = pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array(v.tolist(), pa.list_(pa.float64()))], ["id", "v"])
    near = lambda x: (np.zeros(len(x), np.int64), np.ones((len(x), 20), bool))
    out = list(vector._placed(iter([rows]), near, True))
    assert max(b.num_rows for b in out) <= vector.PLACED_ROWS and sum(b.num_rows for b in out) == 9000 * 20
    first = {(c, i): x for b in out[:40] for c, i, x in zip(*(c.to_pylist() for c in b.columns))}
    assert all(x == v[i].tolist() and c // vector.PIVOTS == 4 for (c, i), x in first.items())
    assert sum(b.num_rows for b in vector._placed(iter([rows]), near, False)) == 9000


def test_a_key_of_many_fingerprints_is_parted(spark, monkeypatch):
    """Fingerprints that agree in all but 12 bits crowd a key; the pairs are those of all against all, and no group is large."""
    monkeypatch.setattr(dedup, "PART", 16)
    rng = random.Random(2)
    marks = list({rng.getrandbits(12) for _ in range(150)} | {rng.getrandbits(60) for _ in range(30)})
    df = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc bigint, simhash bigint")
    want = {(i, j) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in dedup.met(df.withColumnRenamed("doc", "a"), "a", "b", 3).select("a", "b").collect()} == want
    kept = []
    for m in marks:
        if all((m ^ k).bit_count() > 3 for k in kept):
            kept.append(m)
    assert sorted(r.doc for r in dedup.first_of_each(df, 3).collect()) == [marks.index(k) for k in kept]


def test_a_fingerprint_costs_what_its_tokens_do():
    """A batch of 8,000 rows with 240,000 distinct tokens takes about as long as its parts of 500 rows together, and gives the same."""
    rows = pa.array([[f"w{i}x{j}" for j in range(30)] + ["the", "the"] for i in range(8_000)] + [["one"] * 600, [], None], pa.list_(pa.string()))
    begin = time.process_time()
    parts = [simhash_of(rows.slice(at, 500)) for at in range(0, len(rows), 500)]
    middle = time.process_time()
    whole = simhash_of(rows)
    assert time.process_time() - middle < 3 * (middle - begin)
    assert whole.equals(pa.concat_arrays(parts)) and whole[-2:].to_pylist() == [0, 0]
    assert whole[-3] == simhash_of(pa.array([["one"]]))[0]
