import math
import random
import zlib

import numpy as np
import pytest

from corpuslake.llm import langid, quality, toxicity, zdict

VOCAB = {
    "en": "the of and to in that is was for with on as by at from this have be are not".split(),
    "fr": "le la les des et que qui dans pour sur avec une être était pas plus par ce il nous".split(),
    "de": "der die das und nicht mit für über auf ein eine ist von zu den dem sich auch wie grün".split(),
}


def texts(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice(list(VOCAB))
        w = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) if rng.random() < 0.4 else rng.choice(VOCAB[lang]) for _ in range(rng.randint(5, 90))]
        out.append((i, " ".join(w), lang))
    return out


def held(i, m, k):
    return i is not None and zlib.crc32(str(i).encode()) % m == k


def auc(y, s):
    pos, neg = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def test_language_of_held_out_texts(spark):
    rows = texts(random.Random(1), 500)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "fr"), (1003, "the of and to in", None), (1004, "der die das und nicht über " * 4000, "de"), (None, "que qui dans pour sur avec", "fr")]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id bigint, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df, langid.learn(df)).collect()}
    assert len(got) == 506
    apart = [i for i, _, _ in rows if held(i, 4, 2)]
    assert all(got[i].held_out == held(i, 4, 2) for i, _, _ in rows)
    truth = {i: k for i, _, k in rows}
    assert np.mean([got[i].lang_pred == truth[i] for i in apart]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert (got[1004].lang_pred, got[None].lang_pred, got[None].held_out) == ("de", "fr", False)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_examples(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df, langid.learn(df)).collect()] == ["und"]
    assert langid.identify(df.limit(0), langid.learn(df.limit(0))).count() == 0


def test_tables_equal_the_filters():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 257, (5, langid.WINDOW)).astype(np.int32)
    patches = np.stack([x[:, j : x.shape[1] - 3 + j] for j in range(4)], axis=2)
    z = np.einsum("npse,sek->npk", net.embed[patches], net.filters)
    logits = np.maximum(z.max(1) + net.bias, 0) @ net.dense + net.shift
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(langid.Scorer(net).probabilities(x), p, atol=1e-5)


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"], seed=3)
    for w in net.parameters():
        w[...] = w.astype(np.float32)
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 257, (6, 20)).astype(np.int32), rng.integers(0, 3, 6)

    def loss():
        patches = np.stack([x[:, j : x.shape[1] - 3 + j] for j in range(4)], axis=2)
        z = np.einsum("npse,sek->npk", net.embed[patches].astype(float), net.filters.astype(float))
        logits = np.maximum(z.max(1) + net.bias, 0) @ net.dense.astype(float) + net.shift
        return -np.mean(logits[np.arange(6), y] - np.log(np.exp(logits).sum(1)))

    for w, g in zip(net.parameters(), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep = w[at]
        w[at] = keep + 1e-3
        up = loss()
        w[at] = keep - 1e-3
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-3 - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_every_byte_is_in_a_window():
    data = [b"", b"a", bytes(range(1, 128)) * 3, b"x" * 128, b"y" * 129]
    x, counts = langid.text_windows(data)
    at = 0
    for d, n in zip(data, counts):
        part = x[at : at + n]
        at += n
        seen = part[part != langid.PAD]
        assert len(seen) >= len(d) and (len(d) == 0 or part[-1][part[-1] != langid.PAD].tolist() == list(d[-langid.WINDOW :]))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    rows, labels = [], []
    for i, (_, text, _) in enumerate(texts(rng, 900)):
        toxic, bad = rng.random() < 0.25, rng.random() < 0.25
        w = text.split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["horrible", "idiotic", "garbage", "moronic"]))
        if bad:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        rows.append((i, " ".join(w)))
        if i % 10:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


ODD = [(5000, None), (5001, ""), (5002, "plain words here " * 8000), (None, "null id")]


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_labels_of_held_out_texts(spark, labelled, name):
    rows, labels = labelled
    docs = spark.createDataFrame([(*r, 0.5, 9) for r in rows + ODD], "doc_id bigint, text string, score double, label int")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (7, 5, 5)], "doc_id bigint, quality int, toxic int")
    module, cut = (toxicity, 0.5) if name == "toxic" else (quality, 0.3)
    got = {r.doc_id: r for r in module.score(docs, module.learn(docs, marks)).collect()}
    assert len(got) == len(rows) + 4
    truth = {i: (t if name == "toxic" else q) for i, q, t in labels if held(i, 5, 0)}
    assert all(got[i].held_out == held(i, 5, 0) for i, _ in rows)
    assert auc(list(truth.values()), [got[i].score for i in truth]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in got.values())
    assert got[5000].score == got[5001].score


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels_and_empty(spark, module, label):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in module.score(docs, module.learn(docs, none)).collect()} == {0.5}
    assert module.score(docs.limit(0), module.learn(docs.limit(0), none)).count() == 0


def test_sample_leaves_the_held_out_fold(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame([(i, f"{i} {t}") for i, t in rows], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    sample = zdict.labelled_sample(docs, marks, "toxic")
    ids = [int(t.split()[0]) for _, _, t in sample]
    assert ids and not any(held(i, 5, 0) for i in ids)
    assert all(c == held(i, 5, 4) for i, (_, c, _) in zip(ids, sample))


def test_keep_good_keeps_columns(spark, labelled):
    rows, labels = labelled
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.learn(docs, marks)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}


def test_long_texts_have_the_same_windows():
    rng = np.random.default_rng(6)
    scorer = langid.Scorer(langid.Network(["a", "b"], seed=5))
    for extra in (0, 1, 127, 128, 129, 5000):
        data = rng.integers(1, 256, langid.PIECE * 2 + extra, np.uint8).tobytes()
        x, counts = langid.text_windows([data])
        seen = np.concatenate([langid.text_windows([t])[0] for t in langid.split_text(data)])
        assert len(x) == counts[0] == len(seen) and (x == seen).all()
    texts = [b"short", data, b"x" * 300]
    whole = [scorer.probabilities(langid.text_windows([t])[0]).mean(0) for t in texts]
    assert np.allclose(scorer.texts(texts), whole, atol=1e-5)


def plain_logistic(model, row):
    z = sum(w * (x - m) / s for w, x, m, s in zip(model.w, row, model.mean, model.scale)) + model.w[-1]
    return 1 / (1 + math.exp(-max(min(z, 30), -30)))


def test_toxicity_scores_against_single_compressions(spark, labelled):
    """Every score again from its definition: each window compressed alone, features counted plainly."""
    rows, labels = labelled
    docs = spark.createDataFrame(rows[:150] + [r for r in ODD if r[1] is None or len(r[1]) < 100], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), marks)
    toxic, ordinary = ([toxicity.compressor(x) for x in made] for made in (model.toxic, model.ordinary))
    assert len(toxic) == toxicity.PAIRS and all(len(x) > 256 for x in model.toxic + model.ordinary)  # trained, not empty
    for r in toxicity.score(docs, model).collect():
        text = dict(rows + ODD)[r.doc_id] or ""
        d = []
        for w in text.lower().split():
            win = b" " + w.encode() + b" " + toxicity.MARKER
            d.append(sum(len(o.compress(win)) - len(t.compress(win)) for o, t in zip(ordinary, toxic)) / len(toxic))
        row = [0.0] * toxicity.FEATURES
        if d:
            top = sorted((min(x, model.thresholds.at[-1] + 3) - model.thresholds.middle for x in d), reverse=True)
            row = [top[min(i, len(d) - 1)] for i in range(3)]
            for t in model.thresholds.at:
                n = sum(x > t for x in d)
                row += [math.sqrt(n / len(d)), math.log(1 + n) - 0.5 * math.log(1 + len(d))]
        assert abs(r.score - plain_logistic(model.logistic, row)) < 1e-9


def test_quality_scores_against_single_compressions(spark, labelled):
    rows, labels = labelled
    model = quality.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    good, bad = (zdict.compressor(x, trained=True) for x in (model.good, model.bad))
    few = rows[:100] + [(9000, "word " * 3000), (9001, "x" * 5000)]
    for r in quality.score(spark.createDataFrame(few, "doc_id bigint, text string"), model).collect():
        pieces = quality.windows(dict(few)[r.doc_id])
        assert b"".join(pieces) == dict(few)[r.doc_id].encode()
        g, b, n = [len(good.compress(p)) for p in pieces], [len(bad.compress(p)) for p in pieces], [len(p) for p in pieces]
        d = [(y - x) / (y + x) for x, y in zip(g, b)]
        row = [sum(x * k for x, k in zip(d, n)) / sum(n), min(d), max(d), sum(g) / sum(n), sum(b) / sum(n)]
        assert abs(r.score - plain_logistic(model.logistic, row)) < 1e-9
