"""Exact search against all products."""

import numpy as np
import pytest

from eventspark.llm import ball_tree


def brute(rows, every=50, k=5, scale=256.0):
    """Rows as (id, list); the commonest length takes part, the smallest vector of an id counts."""
    whole = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            v = tuple(int(np.clip(np.floor(scale * v), -float(2 ** 63), float(2 ** 63))) for v in map(float, x))
            v = tuple(min(max(c, -(2 ** 63) + 1), 2 ** 63 - 1) for c in v)
            whole[i] = min(whole.get(i, v), v)
    lengths = [len(v) for v in whole.values()]
    commonest = max(set(lengths), key=lambda n: (lengths.count(n), -n), default=0)
    whole = {i: v for i, v in whole.items() if len(v) == commonest}
    out = []
    for q, v in whole.items():
        if q % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(2 ** 63) + 2), 2 ** 63 - 1), i) for i, w in whole.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "vec_id long, embedding array<double>, score string, rank int")
    return sorted(map(tuple, ball_tree.search(df.repartition(3), **options).collect()))


@pytest.mark.parametrize("kind", ["clustered", "isotropic", "crowded"])
def test_search_equals_all_products(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clustered":
        x = rng.normal(size=(12, 6))[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 6))
    else:
        x = rng.normal(size=(1500, 6))
    if kind == "crowded":
        x[:700] = x[0]  # one vector is nearly half of all rows
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    assert run(spark, rows, every=7, cell_rows=100, shard_values=600, leaf_rows=8) == brute(rows, every=7)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(120)]  # many ties, zero vectors among them
    rows += [(None, [1.0] * 4), (200, None), (250, [1.0, None, 1.0, 1.0]), (300, [1.0, float("nan"), 1.0, 1.0]), (350, [float("inf")] * 4),
             (400, [1.0] * 3), (450, []), (50, [9.0] * 4), (50, [9.0] * 4), (-50, [1.0, 0.0, 0.0, 0.5]), (500, [1e300, -1e300, 0.0, 1.0]),
             (2 ** 63 - 1, [3.0] * 4), (-(2 ** 63), [1e17] * 4)]
    assert run(spark, rows, cell_rows=20, shard_values=64, leaf_rows=4) == brute(rows)


def test_few_and_no_vectors(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert run(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])]) == brute([(0, [1.0, 2.0]), (1, [1.0, 1.0])])
    assert run(spark, [(0, []), (1, []), (2, [])]) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_branch_and_bound_leaves_most_leaves_out():
    rng = np.random.default_rng(1)
    x = (256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 8000)] * 3 + 0.1 * rng.normal(size=(8000, 16)))).astype(np.int64)
    ids = np.arange(8000)
    shard = ball_tree.Balls.of(ball_tree.Balls.build(ids, x).row())
    low, high = np.full(80, ball_tree._LOW), np.full(80, ball_tree._HIGH)
    best = ball_tree.search_shard(shard, x[::100], ids[::100], 5, low, high)
    scores = x[::100] @ x.T
    scores[np.arange(80), ids[::100]] = -(2 ** 62)
    want = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.ident == want).all()
    assert best.seen < 0.2 * scores.size
    # with the kth scores of a search that has been made, even less is seen, and nothing is lost
    again = ball_tree.search_shard(shard, x[::100], ids[::100], 5, best.score[:, -1], best.ident[:, -1])
    assert (again.ident == want).all() and again.seen <= best.seen
