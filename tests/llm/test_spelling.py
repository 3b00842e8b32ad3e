"""Spelling variants against plain edit lists, and the filters by themselves."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventspark.llm import spelling_variants as sv

LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]


def brute_words(docs):
    count = Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def brute(words, times=10):
    near = defaultdict(set)
    for w in words:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in LETTERS}
        for e in edits:
            if e != w and e in words:
                near[w].add(e)
                near[e].add(w)
    form = {}
    for w in near:
        best = min(near[w], key=lambda x: (-words[x], x))
        if words[best] >= times * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def run(spark, docs, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in sv.variants(df.repartition(3), **options).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    return sorted(got)


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(2)
    stems = ["elephant", "tomorrow", "straßeßen", "ÀÈÌÒÙéèê", "zzzzzzzz", "abcdefg", "abcdefh"]
    texts = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = stems[int(rng.integers(len(stems)) ** 2 // len(stems))]
            if rng.random() < 0.15:
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w = (w[:at] + w[at + 1:], w[:at] + "x" + w[at:], w[:at] + "é" + w[at + 1:])[kind]
            words.append(w.title() if rng.random() < 0.3 else w)
        texts.append((i, " ".join(words) + ("." if i % 3 else "  42")))
    long = "q" * 3000
    return texts + [(None, "Elephant elephant"), (5, None), (6, ""), (7, long + " " + long[1:] + " " + long + " " + long[1:]), (7, "elephant " * 500),
                    (7, "elephant " * 500), (None, None)]


def test_variants_equal_plain_edits(spark, docs):
    assert run(spark, docs) == brute(brute_words(docs))


def test_many_filters_and_passes_give_the_same(spark, docs):
    assert run(spark, docs, part_words=7, pass_bytes=256) == brute(brute_words(docs))


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaaaa", 2), ("aaaaaaab", 20), ("aaaaaabb", 200), ("aaaaabbb", 2000), ("aaaabbbb", 20000)]
    words = spark.createDataFrame([(w, n) for w, n in chain], "word string, n long")
    _, pairs = sv.near_words(words)
    assert pairs.count() == 8
    forms = spark.createDataFrame([(chain[k][0], chain[k + 1][0]) for k in range(4)], "word string, form string")
    assert {r["word"]: r["root"] for r in sv.roots(forms).collect()} == {w: "aaaabbbb" for w, _ in chain[:4]}


def test_no_words(spark):
    assert run(spark, []) == [] and run(spark, [(1, "a short text"), (2, None)]) == []


def test_filters_lose_nothing_and_hold_little_else():
    rng = np.random.default_rng(0)
    keys, others = (rng.integers(0, 1 << 63, 50_000).astype(np.uint64) for _ in range(2))
    blocks = sv.blocks_for(len(keys))
    bits = sv.build(keys, blocks)
    assert len(sv.may_hold(bits, blocks, keys)) == len(keys)
    assert len(sv.may_hold(bits, blocks, others)) < 0.01 * len(others)
    two = np.concatenate([sv.build(others, blocks), bits])  # filters one after the other
    assert len(sv.may_hold(two, blocks, keys, np.ones(len(keys), np.int64))) == len(keys)


def test_hashes_of_edits_are_those_of_the_edited_words():
    letters = np.frombuffer("zebras\xe9".encode("latin-1"), np.uint8)[None]
    direct = lambda w: sv.hashes(np.array([w], np.uint8))[0]
    word = list(letters[0])
    assert [direct(word[:i] + word[i + 1:]) for i in range(7)] == list(sv._deletions(letters)[0])
    got = np.concatenate([h for _, h in sv._replacements(letters, sv.hashes(letters), np.array([97, 122], np.uint8))])
    want = [direct(word[:i] + [c] + word[i + 1:]) for i in range(7) for c in (97, 122) if c != word[i]]
    assert list(got) == want
