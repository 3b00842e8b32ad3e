"""Searches and near copies of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.llm import multiprobe as mp
from eventspark.llm import pruned_graph as pg


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) * rng.choice([1, 50])).tolist(), int(i % 3)) for i in range(300)]
    rows += [(300, None, 1), (None, [1.0, 2.0, 3.0, 4.0], 1), (301, [0.0] * 4, 1), (302, [1.0, None, 2.0, 3.0], 1), (303, [float("nan")] * 4, 1),
             (304, [1.0, 2.0], 1), (305, [float("inf"), 0.0, 0.0, 0.0], 2), (20, [9.0] * 4, 2), (306, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(400 + i, [1.0] * 4, 1) for i in range(60)]
    rows += [(500 + i, (np.ones(4) + rng.normal(size=4) * 0.05).tolist(), 1) for i in range(80)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def usable(rows):
    want = {}
    for i, x, label in rows:
        if i is not None and x is not None and len(x) == 4 and all(v is not None and np.isfinite(v) for v in x) and any(x):
            want[i] = min(want.get(i, (x, label)), (x, label), key=lambda r: r[0])
    return want


@pytest.mark.parametrize("probes", [None, 1])
def test_search(spark, odd_vectors, probes):
    df, rows = odd_vectors
    want = usable(rows)
    ids = np.array(sorted(want))
    x = np.array([want[i][0] for i in ids])
    hashing = None
    if probes:
        some = mp.store(mp.usable(df), "some")
        hashing = mp.fit(some, some, 20)
        hashing.probes = probes
    got = {}
    for q, rank, i, score in mp.search(df, hashing=hashing).collect():
        got.setdefault(q, []).append((rank, i, score))
    queries = ids[ids % 20 == 0]
    assert sorted(got) == queries.tolist()
    hits = 0
    for q in queries:
        own = sorted(got[q])
        assert [r[0] for r in own] == list(range(1, 21))
        score = (x[ids == q][0] * x).sum(axis=1)
        at = dict(zip(ids.tolist(), score))
        assert all(r[2] == at[r[1]] and r[1] != q for r in own)
        assert [(r[1], r[2]) for r in own] == sorted(((r[1], r[2]) for r in own), key=lambda r: (-r[1], r[0]))
        score[ids == q] = -np.inf
        hits += len({r[1] for r in own} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits / 20 / len(queries) >= (0.9 if probes is None else 0.5)


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in mp.search(df).orderBy("rank").collect()] == [(0, k + 1, 5 - k) for k in range(5)]
    assert mp.search(df.limit(0)).count() == 0 and mp.search(df.limit(1)).count() == 0


def test_recall_over_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in mp.search(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in got:
        score = x[ids == q][0] @ x.T
        score[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits / 20 / len(got) >= 0.9


def brute_links(rows, threshold):
    ids, by, out = [], {}, {}
    for i, x, label in rows:
        if i is None:
            continue
        ids.append(i)
        fine = x is not None and label is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)
        if fine:
            by[i] = min(by.get(i, (x, label)), (x, label))
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = {i: 0 for i in ids}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, (x, _) in by.items()}
    known = sorted(by)
    for k, a in enumerate(known):
        for b in known[:k]:
            if by[a][1] == by[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                a_, b_ = find(a), find(b)
                label[max(a_, b_)] = min(a_, b_)
    for i in ids:
        out[i] = (links[i], find(i), find(i) == i)
    return out


@pytest.mark.parametrize("shard_rows,most_rows", [(500, 1500), (30, 40)])
def test_near_copies(spark, odd_vectors, shard_rows, most_rows):
    df, rows = odd_vectors
    got = {r[0]: tuple(r)[1:] for r in pg.near_copies(df, 0.99, shard_rows, most_rows).collect()}
    want = brute_links(rows, 0.99)
    assert got.pop(None) == (0, None, None)
    assert got.keys() == want.keys()
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong if shard_rows == 500 else len(wrong) <= 0.02 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold


def test_no_rows(spark, odd_vectors):
    assert pg.near_copies(odd_vectors[0].limit(0)).count() == 0


def test_pruned_lists_are_sparse_and_the_walk_finds_the_range():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 8))
    z[200:] = z[:1] + 0.05 * rng.normal(size=(200, 8))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    lists = pg.robust_prune(z)
    assert np.mean([len(x) for x in lists]) < 4 * pg.DEGREE
    graph = pg.Graph(z, lists)
    found = graph.in_range(z, 0.9)
    near = z @ z.T >= 0.9
    assert (found <= near).all() and found.sum() >= 0.99 * near.sum()
    graph.cosines = 0
    lonely = graph.in_range(z[:200], 0.9, seeds=(np.arange(200), np.arange(200)))  # with little in range they leave most others alone
    assert graph.cosines < 0.6 * 200 * 400 and lonely.sum() >= 0.98 * near[:200].sum()


def test_a_dense_group_over_many_shards_loses_no_link(spark):
    """Some thousand distinct near copies in one label: their links are spread over many clusters and blocks."""
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=16) * 2 + 0.25 * rng.normal(size=(3000, 16)), rng.normal(size=(3000, 16))]
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in pg.near_copies(df, shard_rows=60, most_rows=150).collect()}
    near = z @ z.T >= pg.THRESHOLD
    np.fill_diagonal(near, False)
    groups = pg.Groups(len(x))
    groups.add(*np.nonzero(near))
    assert near[:3000, :3000].mean() > 0.5
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == groups.label.tolist()


def test_the_audit_sees_lost_links_and_asks_for_more_overlap(spark, monkeypatch):
    """Walks that are cut short lose links; the audit counts against the whole label, so more overlap is tried, then it says so."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=8) * 2 + 0.2 * rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    seen, walked = [], pg.walked
    monkeypatch.setattr(pg, "MOST_OVERLAP", 4)

    def half(equal, threshold, overlap, *rest):
        seen.append(overlap)
        found, n = walked(equal, threshold, overlap, *rest)
        return found.filter("id % 2 = 0"), n

    monkeypatch.setattr(pg, "walked", half)
    with pytest.raises(RuntimeError, match="audit"):
        pg.near_copies(df, shard_rows=60, most_rows=150)
    assert seen == [2, 4]


def test_far_fewer_cosines_than_pairs(spark):
    """20,000 vectors of one label without structure, and a few near copies among them."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 32))
    x[10_000:10_200] = x[:200] + 0.05 * rng.normal(size=(200, 32))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    equal = pg.entries(df).select(F.col("vec_id").alias("id"), "kind", "x", F.lit(1).cast("long").alias("copies"))
    found, cosines = pg.walked(equal, pg.THRESHOLD, pg.OVERLAP, pg.SHARD_ROWS, pg.MOST_ROWS)
    links = {r["id"]: r["n"] for r in found.groupBy("id").agg(F.sum("links").alias("n")).collect()}
    want = set(range(200)) | set(range(10_000, 10_200))
    assert set(links) <= want and len(links) >= 0.99 * len(want) and set(links.values()) == {1}
    assert cosines < 0.15 * 20_000 * 20_000 / 2


def test_labels_and_lengths_of_any_size(spark):
    long = [1.0] + [0.0] * 4096
    rows = [(1, [1.0], 2 ** 40), (2, [2.0], 2 ** 40), (3, long, 2 ** 40), (4, long, 2 ** 40), (5, [1.0], -(2 ** 40)), (6, [1e200, 1e200], 1), (7, [1e-200, 1e-200], 1),
            (None, [1.0], 1), (8, [1.0], None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label long, kind string, n_links int")
    got = sorted(map(tuple, pg.near_copies(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False),
                          (8, 0, 8, True), (None, 0, None, None)], key=str)


def test_the_cluster_size_does_not_change_the_result(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=8) * 2 + 0.3 * rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    many, few = (sorted(map(tuple, pg.near_copies(df, shard_rows=n, most_rows=2 * n).collect())) for n in (30, 900))
    assert many == few
