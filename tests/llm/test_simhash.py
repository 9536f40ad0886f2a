import random

import numpy as np
import pytest
import xxhash

from corpuslake.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, component_id string"


def brute_fp(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, limit=2):
    fps = [(i, brute_fp(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= limit:
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(fps):
        groups.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((i, f, least[find(k)]) for k, (i, f) in enumerate(fps)), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicate_classes(df).collect()), key=str)


def test_syndromes_make_a_perfect_code():
    ((e, at, n), *_) = simhash.patterns(0)
    assert len(e) == 2048 and (n == 1).all() and sorted(at.tolist()) == list(range(2048))


def test_every_close_pair_shares_an_anchor():
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))))
    for a, b in pairs:
        fp = np.array([a, b], np.uint64).view(np.int64)
        homes, every = {}, {}
        for row, anchor, home in simhash.cover(fp, 2):
            for r, k in zip(row.tolist(), anchor.tolist()):
                every.setdefault(r, set()).add(k)
                if home:
                    homes[r] = k
        assert homes[0] in every[1] and homes[1] in every[0]


def test_matches_brute_force(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(1, 80))
        rows.append((i, " ".join(words)))
        for j in range(rng.randint(0, 3)):
            other = list(words)
            other[rng.randrange(len(other))] = rng.choice(vocab)
            rows.append((100 + 10 * i + j, "  ".join(other).upper()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (3, rows[3][1]), (None, rows[5][1]), (None, "alone with a null id here"), (903, "x " * 20000), (904, "É   é")]
    assert found(spark, rows) == brute_components(rows)


def test_chain_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 103), (101, 103)], "a bigint, b bigint")
    roots = dict(map(tuple, simhash.components(links).collect()))
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [10, 200])
def test_large_anchor_keeps_what_is_connected(n):
    fp = np.array([5 ^ (1 << (i % 17 + 46)) ^ (1 << (i // 17 + 46)) for i in range(n)], np.int64)
    keys = np.zeros(n, np.int64)
    a, b = simhash.links_of(keys, np.arange(n), fp, 2)
    seen, front = {0}, [0]
    near = {}
    for x, y in zip(a.tolist(), b.tolist()):
        near.setdefault(x, []).append(y)
        near.setdefault(y, []).append(x)
    while front:
        for y in near.get(front.pop(), []):
            if y not in seen:
                seen.add(y)
                front.append(y)
    assert seen == set(range(n))
