"""The prefix trie against a brute-force version, with small segments and units, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpuslake.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, unit string, n int, top string, key string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, said, role, text))
    for v in turns.values():
        v.sort()
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = [x[3:] for x in turns.get(base, [])[:h] + turns[c][h:]]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows, **options):
    made = prefix_trie(spark.createDataFrame(rows, SCHEMA), **options)
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in made.collect())


def corpus(seed):
    """Openings in common, equal conversations, gaps in the ids, null and repeated turns, roles that end where texts begin."""
    rng = random.Random(seed)
    rows = []
    ids = rng.sample(range(-250, 450), 60) + [0, 100, 200]
    said = [("user", "héllo"), ("assistant", "x😀"), ("user", None), (None, "a"), ("a", ""), ("", "a"), ("user", "")]
    for c in dict.fromkeys(ids):
        for t in range(rng.choice([1, 2, 3, 5, 6, 9])):
            role, text = rng.choice(said[:2] if t < 3 else said)
            rows.append((c, rng.choice([t, t, t, None]), role, text, "u", 1, "t", "k"))
    rows += [r for r in rows if r[0] % 17 == 0]
    rows += [(None, 1, "user", "nobody's", "u", 1, "t", "k")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"limit": 3, "segment": 2}), (3, {"limit": 1, "segment": 1024}), (4, {"limit": 12, "segment": 3})])
def test_equals_brute_force(spark, seed, options):
    rows = corpus(seed)
    assert found(spark, rows, **options) == brute(rows)


def test_one_long_conversation_and_very_many_copies(spark):
    rows = [(1, t, "user", f"t{t % 7}", "u", 1, "t", "k") for t in range(400)]
    rows += [(c, t, "user", f"copy {t}", "u", 1, "t", "k") for c in range(1000, 1400) for t in range(3)]
    rows += [(c, t, "user", f"t{t % 7}", "u", 1, "t", "k") for c in (7, 8) for t in range(300 + c)]
    assert found(spark, rows, limit=40, segment=16) == brute(rows)


def test_no_rebuilt_turns_ends_at_the_root(spark):
    short = next(c for c in range(101, 199) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(short, 0, "user", "gone", "u", 1, "t", "k")]
    assert found(spark, rows) == brute(rows) == [(short, 0, -(10**9), 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x", "u", 1, "t", "k")]) == []
