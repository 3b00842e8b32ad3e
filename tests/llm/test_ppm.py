"""PPM against a direct implementation, byte by byte."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventspark.llm import ppm, queries

ORDER = ppm.ORDER


class Direct:
    def __init__(self, texts):
        self.follow = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for t in texts:
            b = b"\0" * ORDER + t + b"\xff"
            for p in range(ORDER, len(b)):
                for k in range(ORDER + 1):
                    self.follow[k][b[p - k:p]][b[p]] += 1

    def log_p(self, context, s):
        out, gone = 0.0, set()
        for k in range(ORDER, -1, -1):
            c = self.follow[k].get(context[ORDER - k:])
            rest = {a: n for a, n in (c or {}).items() if a not in gone}
            if not rest:
                continue
            whole = sum(rest.values()) + len(rest)
            if s in rest:
                return out + math.log10(rest[s] / whole)
            out += math.log10(len(rest) / whole)
            gone |= set(c)
        return out - math.log10(256 - len(gone))

    def score(self, t):
        b = b"\0" * ORDER + t + b"\xff"
        return sum(self.log_p(b[p - ORDER:p], b[p]) for p in range(ORDER, len(b)))


def test_paths_keep_texts_apart():
    found, begins = ppm.paths([b"ab", b"", b"c"], 2)
    assert [int(x) for x in found] == [0x61, 0x6162, 0x6162FF, 0xFF, 0x63, 0x63FF] and begins.tolist() == [0, 3, 4]


def test_probabilities_sum_to_one():
    model = Direct([b"abracadabra", b"abbabba"])
    for context in (b"\0abra", b"zzzzz", b"\0\0\0ab"):
        context = context[-ORDER:].rjust(ORDER, b"\0")
        assert sum(10 ** model.log_p(context, s) for s in range(256)) == pytest.approx(1.0)


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, odd_docs, monkeypatch, small):
    if small:  # buckets in parts, sums in levels, parts in copies, documents in many blocks
        for name, value in (("PART_KEYS", 40), ("MERGED_KEYS", 50), ("FAN_IN", 2), ("ASKED_KEYS", 60), ("BLOCK_BYTES", 2000)):
            monkeypatch.setattr(ppm, name, value)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd_docs.collect()]
    out = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 == 2
    learned = [t for d, t in rows if not out(d)]
    words = Counter(w for t in learned for w in t.lower().split())
    n, v = sum(words.values()) + len(learned), len(words) + 1
    model = Direct(learned)
    want = []
    for d, t in rows:
        own = t.lower().split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(learned) + 1) / (n + v + 1))
        want.append((str(d), out(d), len(own) + 1, sum(words[w] > 0 for w in own) + 1, n, base, model.score(t)))
    got = [(str(r[0]), *r[1:]) for r in ppm.score(odd_docs).collect()]
    order = lambda r: (r[0], r[2], round(r[5], 3))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_no_training_text_and_no_rows(spark, odd_docs):
    nobody = odd_docs.filter("doc_id is null")
    for r in ppm.score(nobody).collect():
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["held_out"]
        assert r["score"] <= -math.log10(256) + 1e-6
    assert ppm.score(odd_docs.limit(0)).count() == 0


def test_blocks_do_not_follow_how_a_table_is_split(spark, tmp_path, monkeypatch):
    """Files are read in other parts between the passes, as when executors come or go."""
    rows = [(i, f"text {i} " + f"w{i % 97} x{i % 89} " * (i % 9)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(tuple, ppm.score(docs).collect()))
    key, store = "spark.sql.files.maxPartitionBytes", ppm.store
    before = spark.conf.get(key)

    def other_splits(df, label, *more, **options):
        out = store(df, label, *more, **options)
        if label == "counts":
            spark.conf.set(key, "2k")
        return out

    monkeypatch.setattr(ppm, "store", other_splits)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 1000)
    try:
        got = sorted(map(tuple, queries.op8_lm_scoring(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set(key, before)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-5)


def test_a_path_without_a_value_is_an_error():
    known, value = np.array([3, 5], np.uint64), np.array([0.3, 0.5])
    assert ppm.values_at(known, np.array([5, 3, 5], np.uint64), value).tolist() == [0.5, 0.3, 0.5]
    for wanted in ([4], [6]):
        with pytest.raises(RuntimeError):
            ppm.values_at(known, np.array(wanted, np.uint64), value)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        assert (ppm.unpack_keys(ppm.pack_keys(x)) == x).all() and (ppm.unpack_numbers(ppm.pack_numbers(x)) == x).all()
    assert ppm.unpack_words(ppm.pack_words([b"a", b"bc"])) == [b"a", b"bc"]
