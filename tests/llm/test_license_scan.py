import random
import re
import textwrap

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslake.llm import license_scan as ls
from corpuslake.llm.oracles import ORACLES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(doc_id, text):
    w = split(text)
    found = [(i, label) for phrase, label in ls.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    own, best = set(), 0.0
    lines = [set(split(line)) for line in (text or "").split("\n")]
    for label, tokens in ls.template_words().items():
        span = ls.template_lengths()[label]
        for b in [*lines, *(set(w[i : i + span]) for i in range(len(w)))]:
            if len(b & set(tokens)) >= ls.needed(len(tokens), ls.THRESHOLD) and b >= set(ls.MUST[label]) and not b & set(ls.NEVER.get(label, [])):
                own.add(label)
                best = max(best, len(b & set(tokens)) / len(tokens))
    at = [i for i, _ in found]
    base = sorted({x for _, x in found})
    return doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(own | set(base))), 1.0 if at else best


def test_matches_brute_force(spark):
    notices = list(ls.TEMPLATES.values())
    texts = [None, "", "MIT License", "the mit, license\nAPACHE license mit license", "general public license general public license", "license", "mit", "Ünïcode words"]
    texts += [f"some words\n{n} extra tail\nmore" for n in notices]
    texts += [" ".join(n.split()[: int(len(n.split()) * k)]) for n in notices for k in (0.6, 0.8, 0.9)]
    texts += ["word " * 20000 + "mit license", "\n".join(notices), " ".join(notices), "MIT License"]
    rows = list(enumerate(texts)) + [(2, "MIT License"), (None, "apache license")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, label string, block int")
    got = sorted(map(tuple, ls.scan(df).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)


def test_random_mixtures_match_brute_force(spark):
    rng = random.Random(3)
    pool = [w for n in ls.TEMPLATES.values() for w in split(n)] + ["lesser", "noncommercial", "x1", "x2", "x3"]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = split(rng.choice(list(ls.TEMPLATES.values())))
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            parts.append(" ".join(w[rng.randint(0, 2) :]))
            parts.append(rng.choice(["\n", " ", " filler words here "]))
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ls.scan(df).collect()), key=str)
    assert got == sorted((brute(*r) for r in rows), key=str)
    con = duckdb.connect()
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    con.register("documents", documents)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(con.sql(ORACLES["op4_license_scan"]).select(*names).fetchall(), key=str) == got


def test_other_licenses_get_no_label(spark):
    texts = {
        "this is released under the bsd license": "",
        "licensed under the gnu general public license version 2": "gpl",
        "licensed under the gnu lesser general public license version 3": "gpl",
        "licensed under the gnu general public license version 3": "gpl,gpl-3.0-notice",
        "licensed under a creative commons attribution noncommercial 4.0 international license": "",
        "licensed under the mozilla license, version 2.0": "",
        "released under the MIT license": "mit,mit-notice",
    }
    got = ls.scan(spark.createDataFrame(list(texts.items()), "text string, want string").selectExpr("want AS doc_id", "text")).collect()
    assert sorted((r.doc_id, r.labels) for r in got) == sorted((w, w) for w in texts.values())


def test_each_filter_rejects_blocks(spark):
    """Frequencies decide the order, and blocks that share a prefix word but too few words behind it are rejected before they are counted."""
    counts = {w: 1 for v in ls.template_words().values() for w in v} | {"license": 50, "the": 900, "under": 70, "released": 40, "mit": 30}
    index, ordered, probes = ls.template_index(spark, counts, ls.THRESHOLD)
    assert [w for w in ordered if w in ls.template_words()["mit-notice"]] == ["mit", "released", "license", "under", "the"]
    # five words each: with two prefix words, one needs four of five
    texts = ["released under the mit license", "mit copy granted files software", "conditions mit kind forms under", "released mit"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_key bigint, text string").withColumn("w", ls.words(F.col("text")))
    blocks = ls.candidate_blocks(docs, index, probes).filter("label = 'mit-notice'")
    met = {r.row_key for r in blocks.collect()}
    passed = {r.row_key for r in ls.filtered_blocks(blocks, ordered).collect()}
    assert met == {0, 1, 2} and passed == {0}
    long = blocks.filter(F.size("b") >= F.col("c")).select("row_key").distinct().count()
    assert long == 3  # the length filter alone keeps them: the positional filter rejects two


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_wrapped_notices(spark):
    rows, want = [], {}
    for label, notice in ls.TEMPLATES.items():
        for width in (20, 40, 72):
            for mark in ("", "# ", " * "):
                lines = textwrap.wrap("Copyright the authors. " + notice + " and what follows after it.", width, break_long_words=False, break_on_hyphens=False)
                want[len(rows)] = label
                rows.append((len(rows), "first line\n" + "\n".join(mark + x for x in lines) + "\nlast line"))
    scattered = len(rows)
    rows.append((scattered, "\n".join(f"{w} " + "filler " * 30 for w in ls.TEMPLATES["bsd-notice"].split())))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in ls.scan(df).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in want.items())
    assert got[scattered].labels == "" and got[scattered].score == 0.0
