import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import clean as c
from corpuslake.functions.fingerprint import fnv1a, fnv1a_words, hamming, simhash
from corpuslake.functions.markdown import strip_markdown
from corpuslake.functions.strings import extension, strip
from corpuslake.functions.tokens import tokens

ALPHABET = list("abzAZ09 \t\n\r.,!?\"'<>()[]#*_~|-@:/") + ["　", "​", " ", "中", "文", "一", "é", "½", "²", "Ⅷ", "́", "\x1c", "\x85", "http://", "www.", "a@b.cd", "123456789012345", "---", "  ", "\n\n\n"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]


def column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def is_cjk(ch):
    return "一" <= ch <= "鿿"


def model_tokens(text):
    out, i, t = [], 0, text.lower()
    word = lambda ch: unicodedata.category(ch)[0] in "LN"
    while i < len(t):
        if is_cjk(t[i]):
            out.append(t[i : i + 2] if i + 1 < len(t) and is_cjk(t[i + 1]) else t[i])
            i += 1
        elif word(t[i]):
            j = i
            while j < len(t) and word(t[j]):
                j += 1
            out.append(t[i:j])
            i = j
        else:
            i += 1
    return out


def test_strip(spark):
    values = texts()
    assert column(spark, values, strip) == [t.strip() for t in values]


@pytest.mark.parametrize(
    "name, pattern, to",
    [
        ("control_chars", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""),
        ("urls", r"https?://\S+|ftp://\S+|www\.\S+", c.URL_MARK),
        ("emails", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", c.EMAIL_MARK),
        ("long_numbers", r"\b\d{15,}\b", c.NUMBER_MARK),
        ("spaces", " {2,}", " "),
        ("newlines", "\n{3,}", "\n\n"),
    ],
)
def test_patterns(spark, name, pattern, to):
    values = texts(seed=2)
    assert column(spark, values, c.rule(name)) == [re.sub(pattern, to, t) for t in values]


def test_lines_and_quotes(spark):
    values = texts(seed=3)
    assert column(spark, values, c.rule("line_ends")) == ["\n".join(x.rstrip() for x in t.split("\n")) for t in values]
    assert column(spark, ['a "b" "c', '"', "none", ""], c.quotes) == ["a “b” ”c", "“", "none", ""]


def test_cleaner(spark):
    values = [None, "", " \t\n", "a  b ​c\x00", "3la 一一一 己经", "x\n\n\n\n\ny  "]
    assert column(spark, values, c.clean) == ["", "", "", "a b c", "3Ia —— 已经", "x\n\ny"]
    assert column(spark, values, lambda t: c.clean(t, ocr=False))[4] == "3la 一一一 己经"
    shout = c.TextCleaner().add_rule("shout", F.upper)
    assert column(spark, ["a  b"], shout) == ["A B"]
    assert [x for x in spark.createDataFrame([("a  b ",)], "t string").select(*c.TextCleaner().deltas(F.col("t"))).first().asDict().items() if x[1]] == [("spaces", 1), ("line_ends", 1)]


def test_markdown(spark):
    values = ["# T\n\n**b** _i_ a_b_c", "![alt](x) [t](y)\n> q\n- l", "+++\na: 1\n+++\nbody", None]
    assert column(spark, values, strip_markdown) == ["T\n\nb i abc", "alt t\nq\nl", "body", ""]


def test_extension(spark):
    assert column(spark, ["/a/B.MD", "x.tar.gz", ".txt", "noext", "d.x/y"], extension) == [".md", ".gz", "", "", ""]


def test_tokens(spark):
    values = texts(1500, seed=4) + ["rag技术", "中文检索 a", "½ ² Ⅷ", "é́x"]
    assert column(spark, values, tokens) == [model_tokens(t) for t in values]
    assert column(spark, [None], tokens) == [[]]


def fnv(b):
    h = 0xCBF29CE484222325
    for x in b:
        h = (h ^ x) * 0x100000001B3 % 2**64
    return h


def signed(u):
    return u - 2**64 if u >= 2**63 else u


def model_simhash(text):
    w = [0] * 64
    for t in model_tokens(text):
        h = fnv(t.encode())
        for b in range(64):
            w[b] += 1 if h >> b & 1 else -1
    return signed(sum(1 << b for b in range(64) if w[b] > 0))


def test_fnv(spark):
    values = ["", "a", "foobar", "中文", "é" * 50]
    assert column(spark, values, fnv1a) == [signed(fnv(t.encode())) for t in values]


def test_simhash(spark):
    values = texts(60, seed=5) + ["", "!!", "the same text", "the same text", None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, t string")
    got = {r.k: r.simhash for r in simhash(df, "k", "t").collect()}
    assert got == {i: model_simhash(t or "") for i, t in enumerate(values)}


def test_hamming(spark):
    rows = [(0, 0), (-1, 0), (5, 6), (-(2**63), 1)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    assert [r[0] for r in df.select(hamming(F.col("a"), F.col("b"))).collect()] == [0, 64, 2, 2]


def test_hashes_of_many_words(spark):
    words = ["", "a", "中文", "x" * 64, "y" * 65, "é" * 200]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    native = [r.h for r in df.select("i", fnv1a(F.col("w")).alias("h")).orderBy("i").collect()]
    assert fnv1a_words(words).astype("int64").tolist() == native and fnv1a_words([]).tolist() == []
