import random

import duckdb
import pytest
import sentencepiece
from test_decontam import brute as brute_hits
from test_spm import expected

import corpus_pipeline
from corpuslake.llm import near_dedup
from corpuslake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def make(rng):
    vocab = ["w%04d" % i for i in range(3000)]
    rows = []
    for i in range(40):
        w = rng.choices(vocab, k=rng.randint(60, 300))
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            rows.append((100 + i, " ".join(w)))
            near = list(w)
            near[len(near) // 2] = "other"
            rows.append((200 + i, " ".join(near)))
        if i % 4 == 1:
            rows.append((300 + i, " ".join(w[: len(w) // 2] + rng.choices(vocab, k=len(w) // 2))))
    rows += [(500, None), (501, ""), (502, "x y"), (503, "x y"), (12, rows[3][1]), (None, "only one with a null id"), (None, rows[0][1])]
    return [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]


def test_near_duplicates_against_all_pairs(spark):
    rows = make(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA)
    kept = near_dedup.one_of_each(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    alive, ids = set(got), [i for i, _ in got]
    assert len(ids) == len(set(ids)) and ids.count(None) == 1
    sets = {(i, t): shingles(t) for i, t, *_ in rows}
    for one, x in sets.items():
        for other, y in sets.items():
            if one != other and similarity(x, y) >= 0.9:
                assert not (one in alive and other in alive), (one, other)
        if one not in alive and one[0] is not None:
            assert any(similarity(x, y) >= 0.75 for other, y in sets.items() if other != one), one
    assert {i for i, *_ in rows if i is not None and 300 <= i < 400} <= set(ids)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs.columns, {r.doc_id: r for r in docs.collect()}))
    return out


def test_stages_chain(stages):
    names = [n for n, _, _ in stages]
    assert names == ["quality", "near_duplicates", "repeated_passages", "decontamination", "sentencepiece"]
    for _, columns, _ in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    for (_, _, a), (_, _, b) in zip(stages, stages[1:]):
        assert set(b) <= set(a)


def test_quality_keeps_good_documents(stages):
    kept = stages[0][2]
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    good = [i for i, q in labels if q == 1]
    bad = [i for i, q in labels if q == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.6 * len(bad)


def test_passages_cut_and_benchmark_gone(stages):
    before, cut, clean = stages[1][2], stages[2][2], stages[3][2]
    assert all(cut[i].n_chars == len(cut[i].text) <= len(before[i].text) for i in cut)
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    dirty = {r[0] for r in brute_hits([(i, r.text) for i, r in cut.items()], items) if r[5]}
    assert set(clean) == set(cut) - dirty


def test_ids_are_those_of_the_library(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    docs, ids = stages[3][2], stages[4][2]
    assert set(ids) == set(docs)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(sp, docs[i].text) for i, r in ids.items())


def test_odd_rows_pass_every_stage(spark):
    rows = make(random.Random(9))
    docs = spark.createDataFrame(rows + [(600, "long " * 30000, None, None, None)], SCHEMA)
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        df.collect()


def altered(rng, w, share):
    """A copy with single words changed until its similarity falls to `share` or just above."""
    out, x = list(w), shingles(" ".join(w))
    for k in rng.sample(range(len(w)), len(w)):
        before, out[k] = out[k], "changed%d" % rng.randrange(10**6)
        if similarity(x, shingles(" ".join(out))) < share:
            out[k] = before
    return out


def alive_of(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    return {r.doc_id for r in near_dedup.one_of_each(df).collect()}


def test_single_pairs_at_the_limit_are_all_found(spark):
    rng = random.Random(21)
    texts, near, far = [], set(), set()
    for i in range(60):
        w = ["w%05d" % rng.randrange(30000) for _ in range(rng.randint(80, 200))]
        share = (0.8, 0.85, 0.9)[i % 3]
        texts += [(i, " ".join(w)), (1000 + i, " ".join(altered(rng, w, share)))]
        near.add(1000 + i)
        texts.append((2000 + i, " ".join(w[: int(0.7 * len(w))] + ["x%05d" % rng.randrange(30000) for _ in range(int(0.3 * len(w)))])))
        far.add(2000 + i)
    assert all(similarity(shingles(texts[k][1]), shingles(texts[k + 1][1])) >= 0.8 for k in range(0, len(texts), 3))
    assert all(similarity(shingles(texts[k][1]), shingles(texts[k + 2][1])) < 0.8 for k in range(0, len(texts), 3))
    assert alive_of(spark, texts) == {i for i, _ in texts} - near


def test_crowded_keys_lose_no_pair(spark):
    """Keys shared by many texts below the limit: the only true pairs must come out of them."""
    rng = random.Random(22)
    common = ["c%03d" % i for i in range(60)]
    texts = [(i, " ".join(common + ["u%05d" % rng.randrange(90000) for _ in range(20)])) for i in range(400)]
    texts += [(500 + i, " ".join(texts[i][1].split()[:-2] + ["last%d" % i])) for i in range(0, 400, 10)]
    x = {i: shingles(t) for i, t in texts}
    want = {i for i in x if not any(j < i and similarity(x[i], x[j]) >= 0.8 for j in x)}
    assert want == set(range(400))
    assert alive_of(spark, texts) == want


def test_parted_keys_lose_no_pair(spark, monkeypatch):
    """Keys that are parted, as those of very many texts are, change no result."""
    monkeypatch.setattr(near_dedup, "PART", 8)
    monkeypatch.setattr(near_dedup, "NOTICED", 1)
    test_crowded_keys_lose_no_pair(spark)
    rng = random.Random(24)
    base = ["b%03d" % i for i in range(100)]
    texts = [(i, " ".join(altered(rng, base, 0.9))) for i in range(120)] + [(500 + i, " ".join("z%05d" % rng.randrange(90000) for _ in range(60))) for i in range(30)]
    x = {i: shingles(t) for i, t in texts}
    root = {i: i for i in x}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in x:
        for j in x:
            if i < j and similarity(x[i], x[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert alive_of(spark, texts) == {find(i) for i in x}


def test_unrelated_rows_of_one_id_stay(spark):
    rng = random.Random(23)
    one, other = (" ".join("w%05d" % rng.randrange(30000) for _ in range(100)) for _ in range(2))
    near = one.rsplit(" ", 1)[0] + " last"
    rows = [(7, one), (7, other), (7, near), (7, other), (9, other), (None, "one without an id"), (None, "two have no id at all")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    for part in (df, df.repartition(5), df.orderBy("text")):
        got = sorted(((r.doc_id, r.text) for r in near_dedup.one_of_each(part).collect()), key=str)
        assert len(got) == 4 and (7, other) in got and sum(t in (one, near) for _, t in got) == 1 and sum(i is None for i, _ in got) == 2


def test_near_copies_are_linked_by_op9s_fingerprints(spark, monkeypatch):
    """Without any MinHash pair the covering code still links near copies, and whole shingle sets decide."""
    import numpy as np

    rng, none = random.Random(11), lambda similarity: lambda group, ids, n, key: (np.empty(0, np.int64),) * 3
    monkeypatch.setattr(near_dedup, "near_pairs", none)
    words = [rng.choices(["w%04d" % i for i in range(3000)], k=1500) for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(100 + i, " ".join([*w[:-1], "other"])) for i, w in enumerate(words)]
    mark = lambda t: near_dedup.simhash.majority(near_dedup.simhash.shingle_hashes(t, 3))
    close = {i for i in range(12) if ((mark(rows[i][1]) ^ mark(rows[i + 12][1])) & (2**64 - 1)).bit_count() <= 2}
    assert len(close) >= 8
    rows += [(300, "x y " * 60 + "z"), (301, "x y " * 80 + "u v")]  # repeats decide the fingerprint, not the set of shingles
    kept = {r.doc_id for r in near_dedup.one_of_each(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)).collect()}
    assert kept == {*range(12), 300, 301} | {100 + i for i in range(12) if i not in close}
