"""The alignment of two tokenizers against a version that encodes every text whole and keeps every link."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslake.llm import alignment
from corpuslake.llm.common import table
from corpuslake.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def whole(two, text):
    """The groups of a text that is encoded whole: cut at the ends that a token of either has."""
    if not text or (found := two.encode(text)) is None:
        return []
    groups, i, j, x, y = [], 0, 0, 0, 0
    a, b = found
    start = (0, 0)
    while i < len(a) or j < len(b):
        if x <= y:
            x, i = x + len(two.a_bytes[a[i]]), i + 1
        else:
            y, j = y + len(two.b_bytes[b[j]]), j + 1
        if x == y:
            groups.append((a[start[0] : i], b[start[1] : j]))
            start = (i, j)
    return groups


def brute(rows):
    two = alignment.pair(*PATHS)
    found = [(doc_id, whole(two, text)) for doc_id, text in rows]
    count = Counter()
    for _, groups in found:
        count.update({(a, b) for g in groups for a in g[0] for b in g[1]})
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, groups in found:
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links)
        out.append((doc_id, *sums, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "n", 1, b"g") for r in rows], "doc_id bigint, text string, block string, n int, group binary").repartition(3)
    made = alignment.align(docs, *PATHS, **options)
    assert made.columns == COLUMNS
    return sorted(map(tuple, made.collect()), key=str)


ODD = [
    (1, "The quick brown fox jumps over the lazy dog."), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n new  line\t tab "), (6, "a▁b"), (7, "▁"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "naïve café ﬁ 日本語テキスト 한국어 🙂👩‍👩‍👧 é"), (10, "don't we'll I'd 12345 3.14 x=1;y=2"), (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (12, "The quick brown fox jumps over the lazy dog."),
    (1, "repeated id"), (None, "no id the the the"), (13, " nbsp   em 　 wide \x1c fs \x85 nel   ls"), (14, "zero\x00byte ﻿ bom ​ zw"), (15, "🙂" * 40 + " " + "é" * 33), (16, "\r\n\r\n  x \r\n"), (17, "the " * 50), (18, "end \n"), (19, "good text then ▁ marker"),
]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20, "lexicon_units": 5}])
def test_odd_texts(spark, options):
    assert found(spark, ODD, **options) == brute(ODD)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    made = sorted(map(tuple, alignment.align(docs, *PATHS, block_bytes=50_000).collect()), key=str)
    assert made == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


LETTERS = st.text(st.sampled_from("ab Zé'. \n\t ▁🙂\x00日1,st"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=1, max_size=4))
def test_units_give_whole_texts_their_groups(texts):
    two = alignment.pair(*PATHS)
    block = alignment.Block(alignment.Lexicon(two))
    made = [alignment.units(" " + t) if t and "▁" not in t else None for t in texts]
    block.lexicon.learn(list(dict.fromkeys(u for m in made if m for u in m)))
    for text, own in zip(texts, made):
        block.add(1, text, own)
    for text, doc in zip(texts, block.docs):
        groups = whole(two, text)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert doc[1:] == (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), hashlib.sha256(said.encode()).hexdigest() if groups else "")


def test_long_texts_are_taken_in_pieces():
    text = "some words  of a text\n " * 400
    cut = list(alignment.pieces(text, 1000))
    assert "".join(cut) == " " + text and max(map(len, cut)) < 1100 and len(cut) > 8
    assert [u for p in cut for u in alignment.units(p)] == alignment.units(" " + text)
