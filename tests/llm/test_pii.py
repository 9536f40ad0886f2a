"""Personal data: base spans against Python's patterns, added spans against the trees evaluated one by one, planted cases."""

import hashlib
import random
import re
from collections import Counter

import pytest

from corpuslake.llm import pii
from corpuslake.llm.common import table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEMA = "doc_id bigint, text string, row bigint, kind string, gen int, start int, base string, p double"
COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(zip(pii.KINDS, (EMAIL, IP, CARD, PHONE))):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def brute_base(doc_id, text):
    spans = base_spans(text)
    n = Counter(k for _, k, _ in spans)
    return (doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(said(spans).encode()).hexdigest())


def valid(prefix, n):
    head = prefix + "".join(str((7 * i + len(prefix)) % 10) for i in range(n - len(prefix) - 1))
    return next(head + c for c in "0123456789" if luhn(head + c))


CARD16 = valid("4", 16)
ODD = [
    (1, None), (2, ""), (3, f"pay {CARD16} or {CARD16[:4]} {CARD16[4:8]}-{CARD16[8:12]} {CARD16[12:]}."), (4, "a.b+c%d_e@ex-ample.co.uk, x@y, @z.com, q@w.e_r@t.y"), (5, "1.2.3.4.5.6.7.8 256.1.1.1 0.0.0.0 000255.01.1.1 999999999999.1.1.1 1.2.3"),
    (6, "+1 (743) 555-3824 +1 555 +123456789012345678 ++49 30 1234567 (743) 555-3824"), (7, f"🙂é {CARD16}🙂 a@b.c é"), (8, "9" * 30_000 + " " + "a" * 30_000 + "@b.c"), (9, "1 2 3 4 5 6 7 8 9 0 1 2\n3-4"),
    (10, f"{CARD16} {CARD16}"), (3, "same id +44 20 7946 0958"), (None, "no id 10.0.0.1"), (11, f"{CARD16[:-1]}{(int(CARD16[-1]) + 1) % 10}"), (12, "x.y.z@" + "a." * 5000 + "b"), (13, "plain words only"), (14, "tel ٣٤٥ １２３ 12"), (15, "+1 (743) 555-3824"), (15, "+1 (743) 555-3824"),
]


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "k", 1, 2, "b", 0.5) for r in rows], SCHEMA).repartition(3)
    made = pii.personal_data(docs)
    assert made.columns == COLUMNS
    return sorted(map(tuple, made.collect()), key=str)


def test_base_spans(spark):
    made = found(spark, ODD)
    assert [r[:6] for r in made] == sorted((brute_base(*r) for r in ODD), key=str)
    texts = {r[0]: r[1] for r in ODD}
    for doc_id, *_, spans in made:
        if doc_id != 3:
            assert {x for x in said(base_spans(texts[doc_id])).split(",") if x} <= set(spans.split(","))


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    made = pii.personal_data(docs)
    assert not re.search("Python|Arrow|Pandas", made._jdf.queryExecution().toString())
    got = {r.doc_id: r for r in made.collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert tuple(got[doc_id])[:6] == brute_base(doc_id, text)
        assert not base_spans(text) or set(said(base_spans(text)).split(",")) <= set(got[doc_id].spans.split(","))


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(600):
        number = valid("4" + str(rng.randrange(10**9)), 16)
        phone = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((i, f"the card is {number} of it, phone +1 {phone} said we, at m{i}@x.org on 10.0.{i % 256}.7 or {rng.randrange(10**6)} and 2024-01-{i % 28 + 1:02}"))
    return rows


def test_numbers_that_look_like_base_spans_are_added(spark):
    twice = valid("4999", 16)
    rows = corpus() + [(1000, f"the card is {twice} {twice} of it"), (1001, "phone (743) 555-3824 said we"), (1002, "call 12 of 345 by 2024-01-02"), (1003, "order 123456789012345 stands")]
    got = {r[0]: r for r in found(spark, rows)}
    assert got[1000][1:5] == (0, 0, 0, 0) and got[1000][6] == "card:12:28,card:29:45"
    assert got[1001][6] == "phone:6:20"
    assert got[1002][6] == got[1003][6] == ""
    for doc_id, text in rows[:600]:
        assert got[doc_id][6] == said(base_spans(text))  # nothing inside a base span is added


def test_column_equals_the_trees(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus()] + [(2000 + i, f"{x} {x}") for i, x in enumerate(["4111111111111111", "555 666 7777", "1.2.3.400"])], "doc_id bigint, text string")
    every = pii.candidates(pii.matches(docs))
    table_ = pii.counts(every)
    assert sum(n for *_, n, _ in table_) == every.count()
    model = pii.fitted(table_)
    assert len(model.trees) == pii.ROUNDS and model.thresholds
    for r in pii.scored(every, model).collect():
        x = {k: r[f"f_{k}"] for k in pii.BINS}
        assert all(0 <= x[k] < n for k, n in pii.BINS.items())
        assert r.p == pytest.approx(model.probability(x), abs=1e-12)
        assert r.chosen == (r.base or (not r.held and model.probability(x) >= model.thresholds.get(r.kind, 2)))


def test_trees_lower_the_loss_and_thresholds_hold_their_precision():
    rng = random.Random(3)
    x = lambda: tuple((k, rng.randrange(n)) for k, n in pii.BINS.items())
    vectors = [(v, i % 4, i % 4 == 3, 40, 38 if dict(v)["check"] == 1 and dict(v)["after"] != 2 else 3) for i, v in enumerate(x() for _ in range(400))]
    model = pii.fitted(vectors)
    kept = {k: [0, 0] for k in model.thresholds}
    for v, kind, held, n, good in vectors:
        p = model.probability(dict(v))
        if held and kind in kept and p >= model.thresholds[kind]:
            kept[kind][0] += n
            kept[kind][1] += good
        if dict(v)["check"] == 1 and dict(v)["after"] != 2:
            assert p > 0.7
    assert kept and all(good >= pii.PRECISION * n > 0 for n, good in kept.values())


def test_without_base_spans_nothing_is_added(spark):
    assert found(spark, []) == []
    assert [r[6] for r in found(spark, [(1, "phone (743) 555-3824"), (2, None)])] == ["", ""]
