"""Toxicity and quality: held-out accuracy, and a defined result for every odd row."""

import zlib

import numpy as np
import pytest

from eventspark.llm import common, compression_quality, pu_toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, scored, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = scored.filter("held_out").join(labels, "doc_id").select(label, "predicted", "score").collect()
    return np.array([tuple(r) for r in rows], dtype=float)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    y, p, s = held_out(spark, pu_toxicity.score(docs, labels), "toxic").T
    assert len(y) > 500 and ((s >= 0.5) == p).all()
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.01


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    y, p, s = held_out(spark, compression_quality.score(docs, labels), "quality").T
    assert ((s >= 0.3) == p).all()
    assert p[y == 1].mean() > 0.97 and p[y == 0].mean() < 0.2
    assert abs(s.mean() - y.mean()) < 0.05  # calibrated


@pytest.mark.parametrize("module", [pu_toxicity, compression_quality])
def test_odd_rows(spark, module, odd_docs, odd_labels):
    rows = [tuple(r) for r in module.score(odd_docs, odd_labels).collect()]
    assert len(rows) == odd_docs.count()
    assert all(0.0 <= r[2] <= 1.0 for r in rows)
    for doc, held, *_ in rows:
        assert held == (doc is None or zlib.crc32(str(doc).encode()) % 5 == 0)
    by = {}
    for doc, _, score, _ in rows:
        by.setdefault(doc, set()).add(score)
    assert len(by[0]) == 1 and by[32] == by[33]  # repeated rows alike, null as empty
    assert module.score(odd_docs.limit(0), odd_labels).count() == 0
    none = module.score(odd_docs, odd_labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1


def test_keeping_filters_by_the_score(spark, odd_docs, odd_labels):
    for module, keep, good in ((pu_toxicity, pu_toxicity.keep_clean, 0), (compression_quality, compression_quality.keep_good, 1)):
        kept = keep(odd_docs, odd_labels)
        assert kept.columns == odd_docs.columns
        assert kept.count() == module.score(odd_docs, odd_labels).filter(f"predicted = {good}").count()


def test_risk_estimate_recovers_from_unlabelled_positives():
    """Half of the unlabelled rows are positive; the boundary still lies between the groups."""
    rng = np.random.default_rng(0)
    p = ["bad " + " ".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    u = [t if rng.random() < 0.5 else t.replace("bad ", "ok ") for t in p]
    model = pu_toxicity.fit_sample([(t, 1) for t in p] + [(t, 0) for t in u], 0.5)
    assert model.score("bad a b", {}) > 0.5 > model.score("ok a b", {})


def test_blocks_cover_whole_texts():
    text = "é" * 5000
    assert b"".join(compression_quality.blocks(text)).decode() == text


def test_the_sample_survives_a_repeated_id_and_a_huge_text(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    order = [r[0] for r in labels.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").collect()]
    huge, often = order[0], order[1]
    rows = [(i, "x" * 5000 if i == huge else f"text {i}") for i in range(40)] + [(often, f"text {often}")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sample = common.labelled_sample(docs, labels, "toxic", 20, 4000, common.F.lit(True))
    assert sample == [(f"text {i}", i % 2) for i in order if i != huge]


def test_toxic_labels_alone_are_enough(spark):
    """No label says that a text is clean: the prior is estimated, and the method works as it is meant to."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = pu_toxicity.score(docs, labels.filter("toxic = 1"))
    y, p, _ = held_out(spark, scored, "toxic").T
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.01


def some_rows(seed=3, n=40, features=6):
    rng = np.random.default_rng(seed)
    dense = rng.random((n, features)) < 0.4
    row, feature = np.nonzero(dense)
    return pu_toxicity.Rows(row, feature, n), dense.astype(float)


def test_risk_and_gradient_equal_a_direct_computation():
    (p, dense_p), (u, dense_u) = some_rows(1), some_rows(2, 70)
    w, prior = np.random.default_rng(0).normal(size=7), 0.3

    def direct(w):
        s_p, s_u = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) for x in (dense_p, dense_u))
        return np.array([prior * np.mean(1 - s_p), np.mean(s_u) - prior * np.mean(s_p)])

    s_p, s_u = pu_toxicity.scores(w, p, u)
    assert np.allclose(pu_toxicity.risks(s_p, s_u, prior), direct(w))
    steps = np.eye(7) * 1e-6
    numeric = np.array([(direct(w + e) - direct(w - e)) / 2e-6 for e in steps]).T
    assert np.allclose(pu_toxicity.gradients(s_p, s_u, p, u, 6, prior), numeric, atol=1e-8)


def test_training_lowers_the_risk_and_never_below_zero():
    (p, _), (u, _) = some_rows(1, 200), some_rows(2, 300)
    start = np.r_[np.zeros(6), -1.0]
    w, b = pu_toxicity.train_nnpu(p, u, 6, 0.3)
    toxic, clean = pu_toxicity.risks(*pu_toxicity.scores(np.r_[w, b], p, u), 0.3)
    assert toxic + max(clean, 0.0) < sum(pu_toxicity.risks(*pu_toxicity.scores(start, p, u), 0.3)) and clean > -0.02


def test_the_prior_is_estimated_from_a_feature_of_toxic_texts():
    rng = np.random.default_rng(1)
    toxic = rng.random(20_000) < 0.1
    mark = toxic & (rng.random(20_000) < 0.6)
    one = lambda has: pu_toxicity.Rows(np.flatnonzero(has), np.zeros(has.sum(), int), len(has))
    assert 0.1 <= pu_toxicity.estimated_prior(one(mark[toxic]), one(mark), 1) < 0.12


def test_quality_difference_and_calibration_written_out():
    import zstandard

    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice("the river runs quietly past old mills and gardens".split(), 60)) for _ in range(60)]
    bad = [" ".join(rng.choice("buy now click here free $$$ win !!!".split(), 60)) for _ in range(60)]
    model = compression_quality.fit_sample([(t, 1) for t in good] + [(t, 0) for t in bad], 0.4)

    def size(data, dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(data[at:at + 1024])) for at in range(0, len(data), 1024))

    def difference(text):
        data = text.encode()
        return (size(data, model.bad) - size(data, model.good)) / len(data)

    held = [(t, 1) for t in good[40:]] + [(t, 0) for t in bad[40:]]
    x, y = np.array([difference(t) for t, _ in held]), np.array([label for _, label in held], float)
    assert [model.difference(t) for t, _ in held] == list(x) and model.difference("") == 0.0
    score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
    assert np.allclose(score, [model.score(t) for t, _ in held]) and score[y == 1].min() > score[y == 0].max()
    # the calibration: no slope or offset near it has a smaller weighted loss
    weight = np.where(y == 1, 0.4 / y.mean(), 0.6 / (1 - y.mean()))

    def loss(slope, offset):
        z = slope * x + offset
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-2 * (slope * x.std()) ** 2

    best = loss(model.slope, model.offset)
    assert all(loss(model.slope * (1 + a), model.offset + b) >= best - 1e-9 for a in (-1e-3, 0, 1e-3) for b in (-1e-3, 0, 1e-3))
