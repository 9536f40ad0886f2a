import hashlib
import random
import re

from corpuslake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = split(t)
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            wins.setdefault(tuple(w[s : s + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, who = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if owners := wins.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    who |= owners
        names = ",".join(sorted(str(i) for i in who if i is not None))
        out.append((d, len(w), len(hit), len([i for i in who if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id bigint, text string, token string, pos int")
    b = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, win string")
    return sorted(map(tuple, decontam.contamination(d, b).collect()), key=str)


def fixture():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(40)] + ["É", "ñandú", "日本"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (53, "Single"), (None, items[0][1]), (None, "an item without an id that no other has at all"), (1, items[2][1])]
    docs = []
    for i in range(80):
        w = rng.choices(vocab, k=rng.randint(0, 60))
        if i % 3 == 0:
            item = split(rng.choice(items[:12])[1])
            at = rng.randint(0, max(len(item) - 10, 0))
            w[len(w) // 2 : len(w) // 2] = item[at : at + rng.choice([9, 10, 14])]
        docs.append((i, ", ".join(w).upper() if i % 2 else "\n".join(w)))
    docs += [(200, None), (201, ""), (5, docs[3][1]), (6, docs[6][1]), (None, docs[9][1]), (203, "see: an item without an id that no other has at all."), (202, "w1 " * 30000 + "single")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    assert run(spark, docs, items) == brute(docs, items)


def test_without_literals_or_broadcast(spark, monkeypatch):
    docs, items = fixture()
    monkeypatch.setattr(decontam, "LITERAL_TOKENS", 1)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    docs = [d for d in docs if d[0] != 202]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture()
    assert run(spark, [], items) == []
    assert run(spark, docs[:4], []) == brute(docs[:4], [])


def test_clean_documents_keeps_columns_and_null_texts(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id bigint, text string, win_id string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    kept = decontam.clean_documents(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute(docs, items) if not r[5]), key=str)


def test_windows_are_told_apart_by_128_bits(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id bigint, text string")
    items = spark.createDataFrame([("x", "a b c d e f g h i j k")], "item_id string, text string")
    _, hits, owners = decontam.contained_windows(docs, items)
    assert {len(r.win_id) for r in owners.collect()} == {16} and hits.count() == owners.count() == 2
