"""The trie against dictionaries of prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from eventspark.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, turn_id(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, of in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(of) - 1) * (len(path[-1][1]) if path else 0)
    return sorted(((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, of in members.items()), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, k1 int")
    return sorted((tuple(r) for r in prefix_trie.nodes(df.repartition(3), **options).select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for c in range(-130, 420, 3):
        n = int(rng.integers(0, 9))
        out += [(c, t, "user" if t % 2 else "assistant", "hello" if t == 0 else f"Téxt {int(rng.integers(3))} 🤖") for t in range(n)]
    for c in range(1000, 1090):  # conversations alike in every turn
        out += [(c, t, "user", f"same {t}") for t in range(8)]
    out += [(2000, t, "user", "long" if t % 5 else str(t)) for t in range(300)]
    out += [(2100, t, "user", "long" if t % 5 else str(t)) for t in range(64)]
    out += [(2200, t, "user", "long" if t % 5 else str(t)) for t in range(65)] + [(2300, t, "user", "long" if t % 5 else str(t)) for t in range(64)]
    out += [(None, 1, "user", "nobody"), (500, None, None, None), (500, None, "", ""), (500, 1, None, "x"), (500, 1, "x", None), (500, 1, "x", None),
            (501, 0, "a", "bc"), (502, 0, "ab", "c"), (503, 7, "user", "word " * 50_000), (2 ** 62, 0, "user", ""), (700, 0, "u", "only one")]
    out += [(701 + k, 0, "u", "gone") for k in range(40)]  # many of them end up without a turn or with their base's only one
    return out


def test_trie_equals_dictionaries(spark, rows):
    assert run(spark, rows) == brute(rebuilt(rows))


@pytest.mark.parametrize("shard_turns", [400, 60, 9])
def test_nodes_over_many_shards(spark, rows, shard_turns):
    assert run(spark, rows, shard_turns=shard_turns) == brute(rebuilt(rows))


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "user", "x")]) == []


def test_turnless_conversations(spark):
    some = [c for c in range(101, 400) if zlib.crc32(str(c).encode()) % 6 > 0 and c % 100]
    rows = [(c, 0, "user", "x") for c in some]  # no base: the first turn goes, nothing is left
    got = run(spark, rows, shard_turns=50)
    assert got == brute(rebuilt(rows)) and len(got) == 1 and got[0][1] == 0
