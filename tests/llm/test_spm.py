import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")

from corpuslake.llm import spm  # noqa: E402
from corpuslake.llm.queries import tokenizer_path  # noqa: E402
from corpuslake.llm.spm import Segmenter  # noqa: E402

TEXTS = [None, "", " ", "   ", "a", "a ", " a", "  a  b ", "▁a", " ▁ a▁▁b", "a　b\xa0 x", "ﬁ é é", "\x00a", "<s> a</s>", "a\tb\n\nc d", "日本語 テキスト", "😀 x‍", "x" * 3000, "wor ld " * 9000, "﻿ q", "same", "same"]


def expected(sp, t):
    ids = sp.encode(t or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("block_chunks, table_limit", [(262_144, 1_000_000), (2, 3)])
def test_equals_the_library(spark, block_chunks, table_limit):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    rows = [(i, t, "z") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    for part in (df, df.repartition(7)):
        got = spm.encode_decode(part, tokenizer_path(), block_chunks=block_chunks, table_limit=table_limit).collect()
        want = [(i, *expected(sp, t)) for i, t, _ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@given(st.lists(st.text(" ▁abthé日\t0\x00🙂", max_size=12), min_size=1, max_size=30))
@settings(max_examples=150, deadline=None)
def test_chunks_of_random_texts_join_to_the_library_ids(texts):
    seg = spm.segmenter(tokenizer_path())
    for t in texts:
        assert b"".join(seg.segment(Segmenter.chunks(t))) == np.array(seg.sp.encode(t), "<u4").tobytes()


def test_each_distinct_chunk_is_segmented_once(spark, tmp_path, monkeypatch):
    """Over all blocks and partitions: the table's parts get a chunk from every block, but segment it once."""
    rows = [(i, f"common words {i % 7} own{i} ") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    lists = spm.block_rows(df, 5, True, 50)
    sent = [c for r in lists.collect() for c in spm.unpacked_texts(r.blob)]
    assert len(sent) > len(set(sent)) + 30  # blocks share chunks
    places = {}
    for r in lists.collect():
        for c in spm.unpacked_texts(r.blob):
            places.setdefault(c, set()).add(r.part)
    assert all(len(p) == 1 for p in places.values())
    calls = []

    class Counting(spm.Segmenter):
        def segment(self, chunks):
            calls.extend(chunks)
            return super().segment(chunks)

    counting = Counting(tokenizer_path())
    monkeypatch.setattr(spm, "segmenter", lambda model: counting)

    class Frame:  # runs the table's function here, over all lists in order of their part
        sparkSession = spark

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, run, _):
            ordered = lists.orderBy("part").toArrow().combine_chunks().to_batches()
            return list(run(iter(ordered)))

    out = spm.table_ids(Frame(), tokenizer_path(), 5, 10**6)
    assert len(out) == lists.count()
    assert sorted(calls) == sorted(set(sent))


def test_a_changed_input_is_told(spark):
    key = b"k" * 32
    lists = [(key, 0, None, spm.packed(np.array([1]), np.array([5], "<u4").tobytes()))]
    kept = pa.BufferOutputStream()
    with pa.ipc.new_stream(kept, pa.schema([("doc_id", pa.int64())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array([1])], ["doc_id"]))
    texts = [(key, 3, kept.getvalue().to_pybytes(), spm.packed(np.array([2, 1]), np.array([0], "<u4").tobytes()))]
    df = spark.createDataFrame([(a, b, c, bytearray(d)) for a, b, c, d in lists + texts], spm.ROW)
    with pytest.raises(Exception, match="the input changed"):
        spm.joined(df, tokenizer_path(), 3, False).collect()


def test_model_allows_chunks():
    assert spm.segmenter(tokenizer_path()).splits


def test_ids_kept_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id bigint, text string")
    row = spm.encode_decode(df, tokenizer_path(), keep_ids=True).first()
    assert row.decoded == "ab cd" and row.n_tokens == len(row.ids)
    assert spm.encode_decode(df.limit(0), tokenizer_path()).count() == 0
