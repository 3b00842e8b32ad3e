"""Fingerprints, index and groups against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from eventspark.llm import gray_simhash as gs


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(ids, prints, max_bits=2):
    prints = np.array(prints, dtype=np.uint64)
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= max_bits):
            label[find(int(j))] = find(i)
    least = {}
    for i in range(len(prints)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(prints))]


@given(st.text(alphabet="aB \n\té", max_size=40))
def test_fingerprint(text):
    assert gs.fingerprint(text) == brute_fingerprint(text)


def test_gray_rank_orders_neighbours_by_one_bit():
    n = np.arange(1 << 10, dtype=np.uint64)
    gray = n ^ (n >> np.uint64(1))
    assert (gs.gray_rank(gray) == n).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 255)), max_size=60), st.integers(0, 3))
def test_index_finds_every_link_of_a_tree(rows, max_bits):
    rows = sorted(set(rows))
    tree, bits = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64)
    index = gs.GrayIndex(tree, bits)
    found = {frozenset(index.order[[a, b]].tolist()) for x, y in index.links(max_bits) for a, b in zip(x, y)}
    want = {frozenset((i, j)) for i in range(len(rows)) for j in range(i)
            if tree[i] == tree[j] and bin(int(bits[i] ^ bits[j])).count("1") <= max_bits}
    assert found == want


@pytest.mark.parametrize("node_fingerprints", [gs.NODE_FINGERPRINTS, 3])
def test_groups_of_near_fingerprints(spark, node_fingerprints):
    """Chains, a dense group, and upper nodes that are divided again."""
    rng = np.random.default_rng(3)
    prints = set(int(x) for x in rng.integers(0, 1 << 63, 60))
    for base in list(prints)[:12]:
        for _ in range(6):
            base ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(base)
    prints |= {7 ^ (1 << a) for a in range(40)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    heads = dict(gs.fingerprint_components(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, node_fingerprints).collect())
    mine = [heads.get(p, p) for p in signed]
    want = brute_groups(list(range(len(prints))), prints)
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_odd_rows_and_keeping_one(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_groups([r[0] for r in rows], prints)
    want = sorted((str(r[0]), f"{p:016x}", str(g)) for r, p, g in zip(rows, prints, groups))
    got = sorted((str(a), b, str(c)) for a, b, c in gs.near_copies(odd_docs).collect())
    assert got == want
    kept = gs.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for g in groups if g is not None})
    assert gs.near_copies(odd_docs.limit(0)).count() == 0 and gs.keep_one(odd_docs.limit(0)).count() == 0


def test_a_group_without_ids_keeps_one_row(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "x y z w v")], "doc_id long, text string")
    assert gs.keep_one(docs).count() == 2
