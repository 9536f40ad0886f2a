import random

import numpy as np
import pytest

from corpuslake.llm import chaining
from corpuslake.llm.chaining import Plan

PLAN = Plan()


def brute_value(x, y, plan):
    f = []
    for j in range(len(x)):
        best = 0.0
        for i in range(j):
            if x[i] < x[j] and y[i] < y[j]:
                best = max(best, f[i] - plan.gap_cost * ((x[j] - x[i]) + (y[j] - y[i])))
        f.append(plan.seed_value + best)
    return max(f)


def value(x, y, path, plan):
    v = plan.seed_value * len(path)
    for i, j in zip(path[:-1], path[1:]):
        assert x[i] < x[j] and y[i] < y[j]
        v -= plan.gap_cost * ((x[j] - x[i]) + (y[j] - y[i]))
    return v


def test_best_chain_equals_quadratic_search():
    rng = random.Random(5)
    for _ in range(200):
        pairs = sorted({(rng.randrange(3000), rng.randrange(3000)) for _ in range(rng.randint(1, 25))})
        x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        found = chaining.chains(x, y, PLAN)
        assert abs(value(x, y, found[0].tolist(), PLAN) - brute_value(x, y, PLAN)) < 1e-6
        used = np.concatenate(found)
        assert len(used) == len(set(used.tolist())) == len(x)


def test_common_words():
    assert chaining.common_words(list("abcbdab"), list("bdcaba")) == 4
    assert chaining.common_words([], list("a")) == 0


def corpus(rng):
    vocab = ["w%03d" % i for i in range(800)]
    text = lambda n: rng.choices(vocab, k=n)
    passage, short = text(60), text(30)
    docs = {}
    for i in range(12):
        docs[i] = text(120)
    for i in (3, 5, 8):
        docs[i][40:40] = passage
    for i in (1, 9):
        docs[i][10:10] = short
    fuzzy = list(docs[2])
    for k in (20, 60, 95):
        fuzzy[k] = "changed"
    docs[20] = fuzzy
    docs[21] = docs[4]
    docs[22] = docs[0][:49]
    return docs, passage


def test_finds_passages_and_nothing_else(spark):
    docs, passage = corpus(random.Random(11))
    rows = [(i, " ".join(w).title() if i % 2 else ", ".join(w), "x") for i, w in docs.items()]
    rows += [(30, None, "x"), (31, "", "x"), (32, "w1 " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    got = chaining.repeated_passages(df).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in got}
    assert pairs == {(5, 3), (8, 3), (20, 2), (21, 4)}
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        cut = texts[r.doc_id][r.start : r.end]
        assert r.n_equal >= 50 and r.identity >= 0.8
        if r.doc_id in (5, 8):
            assert chaining.WORD.findall(cut.lower()) == passage
        if r.doc_id == 20:
            assert cut == texts[20] and r.n_equal == 117


def test_cuts_passages(spark):
    docs, passage = corpus(random.Random(12))
    rows = [(i, " ".join(w), "s", 7) for i, w in docs.items()] + [(30, None, "s", None), (None, " ".join(docs[6]), "s", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_chars bigint")
    kept = chaining.without_repeats(df)
    assert kept.columns == df.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {*docs, 30} - {20, 21} and got[30].text is None
    assert got[3].text == " ".join(docs[3])
    assert " ".join(passage) not in got[5].text
    assert got[5].text.split() == docs[5][:40] + docs[5][100:] and got[5].n_chars == len(got[5].text)


def test_repeated_ids_and_empty_table(spark):
    rng = random.Random(13)
    docs, _ = corpus(rng)
    rows = [(7, " ".join(docs[0])), (7, " ".join(docs[0])), (9, " ".join(docs[1]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = chaining.repeated_passages(df).collect()
    assert [(r.doc_id, r.first_doc_id) for r in got] == [(7, 7)]
    assert chaining.repeated_passages(df.limit(0)).count() == 0
    assert chaining.without_repeats(df.limit(0)).count() == 0


def test_exact_repeats_whose_parts_are_first_seen_elsewhere(spark):
    rng = random.Random(14)
    fresh = lambda n: ["w%05d" % rng.randrange(90000) for _ in range(n)]
    rows, want = [], {}
    for g in range(40):
        x, y, lap = ((30, 30, 0), (45, 45, 0), (33, 33, 7), (45, 45, 7), (25, 25, 0))[g % 5]
        passage, at = fresh(x + y - lap), 10 * g
        for i, part in ((1, passage[:x]), (2, passage[-y:]), (5, passage), (8, passage)):
            rows.append((at + i, " ".join(fresh(40) + part + fresh(40))))
        want[at + 8] = (at + 5, passage)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, texts = chaining.repeated_passages(df).collect(), dict(rows)
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(i, j) for i, (j, _) in want.items()}
    for r in got:
        assert texts[r.doc_id][r.start : r.end].split() == want[r.doc_id][1] == texts[r.first_doc_id][r.first_start : r.first_end].split()
    kept = {r.doc_id: r.text for r in chaining.without_repeats(df).collect()}
    assert all(len(kept[i].split()) == 80 for i in want)


def covered(spans, s, e):
    return any(a <= s and e <= b for a, b in spans)


def test_every_repeated_window_is_covered_and_every_passage_is_like(spark):
    """End to end against brute force: all windows of 50 words that an earlier text has, whole texts of few words included."""
    rng = random.Random(15)
    vocab = ["v%02d" % i for i in range(40)]
    base = [rng.choices(vocab, k=rng.randint(55, 130)) for _ in range(12)]
    texts = []
    for i in range(90):
        w = rng.choices(vocab, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(base)
            a = rng.randint(0, 20)
            w += p[a : a + rng.randint(30, 110)] + rng.choices(vocab, k=rng.randint(0, 30))
        if i % 9 == 0:
            w += ["ab"] * rng.randint(50, 400)  # equal windows at many places
        if i % 11 == 0:
            w += ["x", "y", "z"] * rng.randint(20, 90)
        texts.append((i, " ".join(w)))
    got = {}
    lists = {i: t.split() for i, t in texts}
    for r in chaining.repeated_passages(spark.createDataFrame(texts, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        a, b = texts[r.doc_id][1][r.start : r.end].split(), texts[r.first_doc_id][1][r.first_start : r.first_end].split()
        assert r.first_doc_id < r.doc_id and chaining.common_words(a, b) >= r.n_equal >= 50 and r.n_equal >= 0.8 * max(len(a), len(b))
    seen, met = set(), 0
    for i, w in lists.items():
        starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in w]))).tolist()
        windows = {k: tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        for k, win in windows.items():
            if win in seen:
                met += 1
                s, e = starts[k], starts[k + 50] - 1
                reach = sorted(got.get(i, []))
                assert covered(reach, s, e) or all(any(a <= starts[m] and starts[m + 1] - 1 <= b for a, b in reach) for m in range(k, k + 50)), (i, k)
        seen |= set(windows.values())
    assert met > 500


def test_share_of_fuzzy_passages_found(spark):
    """Scattered substitutions: how many of 40 pairs each are found, by length and identity."""
    rng = random.Random(16)
    fresh = lambda n: ["w%05d" % rng.randrange(90000) for _ in range(n)]
    kinds, rows = ((60, 0.95), (55, 0.91), (80, 0.85), (80, 0.82), (120, 0.9), (120, 0.82)), []
    for g, (n, share) in enumerate(kinds):
        for m in range(40):
            p = fresh(n)
            q = list(p)
            for k in rng.sample(range(1, n - 1), round(n * (1 - share))):
                q[k] = fresh(1)[0]
            at = 1000 * g + 2 * m
            rows += [(at, " ".join(fresh(60) + p + fresh(60))), (at + 1, " ".join(fresh(60) + q + fresh(60)))]
    got = {(r.doc_id, r.first_doc_id) for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(a == b + 1 for a, b in got)
    share = [sum(a // 1000 == g for a, _ in got) / 40 for g in range(len(kinds))]
    print(dict(zip(kinds, share)))
    assert min(share) >= 0.9, share


@pytest.mark.parametrize("halves", [(45, 45, 0), (48, 48, 6)])
def test_share_of_fuzzy_passages_whose_parts_are_first_seen_elsewhere(spark, halves):
    """Two texts, or many, have one half of a passage each, a third the whole, a fourth the whole with six substitutions."""
    rng = random.Random(19)
    fresh = lambda n: ["w%05d" % rng.randrange(90000) for _ in range(n)]
    x, y, lap = halves
    rows = []
    for g in range(40):
        p = fresh(x + y - lap)
        q = list(p)
        for k in rng.sample(range(1, len(p) - 1), 6):
            q[k] = fresh(1)[0]
        parts = [p[:x], p[-y:]] * (1 if g % 2 else 9) + [p, q]
        rows += [(100 * g + i, " ".join(fresh(40) + part + fresh(40))) for i, part in enumerate(parts)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    found = {r.doc_id // 100 for r in got if r.doc_id == r.first_doc_id + 1 and r.n_equal >= 50}
    print(len(found))
    assert len(found) >= 36 and len(got) == len(found)


def test_a_second_fuzzy_occurrence_in_one_text_is_found(spark):
    rng = random.Random(20)
    fresh = lambda n: ["w%05d" % rng.randrange(90000) for _ in range(n)]
    rows, met = [], 0
    for g in range(20):
        p = fresh(100)
        copies = []
        for _ in range(2):
            q = list(p)
            for k in rng.sample(range(1, 99), 8):
                q[k] = fresh(1)[0]
            copies += q + fresh(50)
        rows += [(10 * g, " ".join(fresh(30) + p)), (10 * g + 1, " ".join(fresh(30) + copies))]
    texts = dict(rows)
    for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert r.n_equal >= 50 and r.doc_id == r.first_doc_id + 1
        met += len(texts[r.doc_id][r.start : r.end].split()) >= 80
    assert met >= 36


def test_long_gaps_and_ends_are_aligned_whole(spark):
    """Beyond the slices fetched at first and beyond any fixed number of words in a gap."""
    rng = random.Random(17)
    fresh = lambda n: ["w%05d" % rng.randrange(90000) for _ in range(n)]
    long = fresh(9000)
    far = list(long)
    for k in range(0, 9000, 500):
        far[k] = "other"
    shared = fresh(1200)  # its middle is first seen in a third text
    rows = [(0, " ".join(long)), (1, " ".join(shared[100:1100])), (2, " ".join(shared)), (5, " ".join(fresh(30) + far + fresh(30))), (6, " ".join(shared))]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    whole = {(r.doc_id, r.first_doc_id): r for r in got}
    assert whole[5, 0].n_equal == 9000 - 18 and whole[5, 0].n_words == 8999
    assert whole[6, 2].n_equal == 1200 and whole[2, 1].n_equal == 1000


def test_common_words_against_the_table():
    rng = random.Random(18)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 90)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for w in a:
            before = 0
            for j, v in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
        assert chaining.common_words(a, b) == row[-1]


@pytest.mark.parametrize("wrong", [{"window": 16}, {"window": 0}, {"min_words": 11}])
def test_settings_that_lose_passages_are_refused(wrong):
    with pytest.raises(ValueError):
        Plan(**wrong)


def test_seeds_of_many_texts_are_those_of_each():
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["a", "bb", "Ünï", "中文", "w%d" % rng.randrange(40)]) for _ in range(rng.choice([0, 3, 49, 50, 51, 300]))) for _ in range(60)]
    texts += [None, "", "same " * 200]
    every = chaining.seeds(texts, PLAN)
    for i, text in enumerate(texts):
        alone = chaining.seeds([text], PLAN)
        assert all((x[every[1] == i] == y).all() for x, y in zip(every[:1] + every[2:], alone[:1] + alone[2:]))
        assert not len(alone[0]) or len(text.split()) >= PLAN.min_words


def test_a_chance_meeting_is_aligned_by_what_lies_near(monkeypatch):
    """Of two long texts with one common run of words little is read, and the result is that of the whole texts."""
    rng = random.Random(4)
    run = " ".join(f"common{i}" for i in range(12))

    def around(name):
        left, right = (" ".join(f"{name}{rng.randrange(10**6)}" for _ in range(2_000)) + " " for _ in range(2))
        return left + run + " " + right, [len(left), len(left) + run.index("common5")]

    (a, xs), (b, ys) = around("a"), around("b")
    want = chaining.along(a, b, xs, ys, PLAN, (0,) * 4)
    read, lower = [], chaining.lower
    monkeypatch.setattr(chaining, "lower", lambda text: read.append(len(text)) or lower(text))
    assert chaining.align(a, b, xs, ys, PLAN) == want == ([], (False,) * 4)
    assert sum(read) < 2_000


def test_near_words_first_give_the_alignment_of_all_words():
    rng = random.Random(8)
    for _ in range(300):
        common = [f"c{rng.randrange(50)}" for _ in range(rng.randrange(8, 120))]
        texts = []
        for name in "ab":
            left, right = ([f"{name}{rng.randrange(90)}" for _ in range(rng.choice([0, 5, 30, 90]))] for _ in range(2))
            changed = [w if 3 < i < 9 or rng.random() > 0.08 else f"{name}x" for i, w in enumerate(common)]
            texts.append((" ".join([*left, *changed, *right]), len(" ".join([*left, *changed[:4], ""]))))
        (a, x), (b, y) = texts
        assert chaining.align(a, b, [x], [y], PLAN)[0] == chaining.along(a, b, [x], [y], PLAN, (0,) * 4)[0]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_common_seeds_that_are_dealt_out_find_the_same(spark, monkeypatch):
    docs, _ = corpus(random.Random(11))
    line = " ".join(f"line{i}" for i in range(14))
    rows = [(i, " ".join([*w, line]) if i % 3 else f"{line} {' '.join(w)} {line}") for i, w in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, kept = rows_of(chaining.repeated_passages(df)), rows_of(chaining.without_repeats(df))
    assert len(want) >= 4
    every = np.unique(chaining.seeds([t for _, t in rows], PLAN)[0])
    for some in (every, every[::2]):
        monkeypatch.setattr(chaining, "common_seeds", lambda *_, some=some: some)
        assert rows_of(chaining.repeated_passages(df)) == want
        assert rows_of(chaining.without_repeats(df)) == kept


def test_common_seeds_are_those_that_would_fill_a_part(spark, monkeypatch):
    rng = random.Random(3)
    line = " ".join(f"line{i}" for i in range(14))
    rows = [(i, " ".join(["w%06d" % rng.randrange(10**6) for _ in range(80)] + [line] * (i % 2))) for i in range(40)]
    docs = chaining.numbered(spark.createDataFrame(rows, "doc_id bigint, text string"))
    monkeypatch.setattr(chaining, "LOOK", 1)
    inside = chaining.seeds([" ".join([line] * 8)], PLAN)[0]
    common = chaining.common_seeds(docs, PLAN, 20)
    assert 0 < len(common) and set(common.tolist()) < set(inside.tolist()) and (np.diff(common) > 0).all()
    assert not len(chaining.common_seeds(docs, PLAN, 1))  # of a single part they are little
    parts = chaining.seed_rows(docs, PLAN, common, 20).filter("deal > 0").select("h", "uid", "deal").distinct().groupBy("h").count().collect()
    assert len(parts) == len(common) and all(r["count"] == 20 for r in parts)


def test_slices_are_those_of_the_text(spark):
    texts = ["plain words", "Ünï naïve ÿ", "中文 Ünï", "a𝒳b 中 é", "", "\x00é\x7f"]
    rows = [(i, t, b, n) for i, t in enumerate(texts) for b in range(5) for n in (0, 1, 3, 99)]
    df = spark.createDataFrame(rows, "uid bigint, text string, b int, n int")
    raw = chaining.even(df.select("uid", "text").distinct())
    assert {r.uid: r.width for r in raw.collect()} == {0: 1, 1: 1, 2: 2, 3: 4, 4: 1, 5: 1}
    from pyspark.sql import functions as F

    got = df.join(raw, "uid").select("text", "b", "n", chaining.piece(F.col("b"), F.col("n")).alias("cut")).collect()
    assert len(got) == len(rows) and all(r.cut == r.text[r.b : r.b + r.n] for r in got)


def test_no_step_leaves_shuffle_files_or_a_table_of_all_seeds(spark, monkeypatch):
    """A table of all seeds and the shuffles of all steps made the disk of 2.9 x the input at 0.5 GB."""
    import time

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in files.mkString("|").split("|") if "shuffle_" in f and f.endswith(".data")}

    labels, write = [], chaining.materialize
    monkeypatch.setattr(chaining, "materialize", lambda df, label: labels.append(label) or write(df, label))
    docs, _ = corpus(random.Random(11))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    before = shuffles()
    lists = chaining.repeated_seeds(chaining.numbered(df), PLAN)
    assert lists.count() and labels == ["common", "lists"]
    rare = {i for i, w in docs.items()} - {r.uid for r in lists.collect()}
    assert 22 in rare  # too short
    from pyspark.sql import functions as F

    seeds = lists.select("uid", F.inline("seeds")).collect()
    assert all(r.first_uid <= r.uid for r in seeds) and any(r.first_uid < r.uid for r in seeds)
    small = lists.select(F.inline("seeds")).groupBy("h").count()  # a shuffle of a written table
    written = chaining.materialize(small, "small")
    for _ in range(50):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.2)
    assert len(left) <= 2 * 4 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # numbered() and counts, which aren't written
    chaining.discard(written)
    chaining.discard(lists)
