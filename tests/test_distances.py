import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.operators import distances as ds


def sample_values(spark, a, b):
    rows = [("f", "ref", float(x)) for x in a] + [("f", "gen", float(x)) for x in b]
    return spark.createDataFrame(rows, "feature string, sample string, value double")


def test_wasserstein(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=300).round(1)
    assert ds.wasserstein(sample_values(spark, a, a), ["feature"]).first().w1 == 0
    assert ds.wasserstein(sample_values(spark, a, a + 3), ["feature"]).first().w1 == pytest.approx(3)
    b = rng.normal(1, 2, size=150)
    points = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(np.sort(a), points[:-1], "right") / 300 - np.searchsorted(np.sort(b), points[:-1], "right") / 150)
    assert ds.wasserstein(sample_values(spark, a, b), ["feature"]).first().w1 == pytest.approx((gap * np.diff(points)).sum())


def vectors(spark, n=120, d=4, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + (np.arange(n) % 2)[:, None] * 0.4
    rows = [(i, "ref" if i % 2 == 0 else "gen", [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "event_id bigint, sample string, x array<double>"), x


def batches(spark, df, n):
    return {r.event_id: r.batch for r in df.select("event_id", ds.batch_of("event_id", n).alias("batch")).collect()}


def test_kernel_distance_equals_all_pairs(spark):
    df, x = vectors(spark)
    which = batches(spark, df, 3)
    x = x / np.abs(x[::2]).max(axis=0)

    def k(a, b):
        return (a @ b.T / x.shape[1] + 1) ** 4

    got = {r.batch: r.mmd2 for r in ds.kernel_distance_batches(df, 3).collect()}
    for batch in range(3):
        ref = x[[i for i in range(0, len(x), 2) if which[i] == batch]]
        gen = x[[i for i in range(1, len(x), 2) if which[i] == batch]]
        own = lambda m: (k(m, m).sum() - np.trace(k(m, m))) / (len(m) * (len(m) - 1))
        assert got[batch] == pytest.approx(own(ref) + own(gen) - 2 * k(ref, gen).mean(), rel=1e-9, abs=1e-12)
    row = ds.kpd(df, 3).first()
    assert row.kpd_median == pytest.approx(np.median(list(got.values())))


def test_moments(spark):
    df, x = vectors(spark, 200, 3)
    got = {(r["sample"], r.i, r.j): r["cov"] for r in ds.feature_mean_cov(df.repartition(5)).collect()}
    for sample, part in (("ref", x[::2]), ("gen", x[1::2])):
        cov = np.cov(part, rowvar=False)
        for i, j in itertools.combinations_with_replacement(range(3), 2):
            assert got[sample, i, j] == pytest.approx(cov[i, j])


def test_frechet():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 3)), rng.normal(1, 2, size=(60, 3))
    ca, cb = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    roots = np.sqrt(np.linalg.eigvals(ca @ cb).astype(complex)).real.sum()
    expected = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * roots
    assert ds.frechet(a.mean(0), ca, b.mean(0), cb) == pytest.approx(expected)
    assert ds.frechet(a.mean(0), ca, a.mean(0), ca) == pytest.approx(0, abs=1e-9)


def test_fpd_equals_brute_force(spark):
    df, x = vectors(spark, 600, 3)
    which = batches(spark, df, 5)
    x = x / np.abs(x[::2]).max(axis=0)
    sizes, found = [], []
    for k in range(1, 6):
        ref = x[[i for i in range(0, 600, 2) if which[i] < k]]
        gen = x[[i for i in range(1, 600, 2) if which[i] < k]]
        sizes.append(min(len(ref), len(gen)))
        found.append(ds.frechet(ref.mean(0), np.cov(ref, rowvar=False), gen.mean(0), np.cov(gen, rowvar=False)))
    fit, cov = np.polyfit(1 / np.array(sizes), found, 1, cov=True)
    value, error = ds.fpd(df, 5)
    assert value == pytest.approx(fit[1]) and error == pytest.approx(np.sqrt(cov[1, 1]))


def test_coverage_equals_brute_force(spark):
    df, x = vectors(spark, 90, 4)
    x = x / np.abs(x[::2]).max(axis=0)
    df = df.filter("event_id % 2 = 0 or event_id < 60")  # samples of 45 and 30
    batch = {r.event_id: r.b for r in df.select("event_id", ds.batch_of("event_id", 2).alias("b")).collect()}  # by the smaller one
    got = {r.batch: r for r in ds.coverage_batches(df, 20).collect()}
    assert sum(r.n for r in got.values()) == 45
    for b, r in got.items():
        m, g = (x[[i for i in sorted(batch) if batch[i] == b and i % 2 == side]] for side in (0, 1))
        d = np.linalg.norm(m[:, None] - g[None], axis=2)
        assert r.n == len(m) and r.mmd == pytest.approx(d.min(1).mean()) and r.coverage == pytest.approx(len(set(d.argmin(0))) / len(m))


def test_coverage_of_a_batch_without_generated_events(spark):
    df = spark.createDataFrame([(i, "ref" if i < 40 else "gen", [1.0 * i]) for i in range(41)], "event_id bigint, sample string, x array<double>")
    rows = ds.coverage_batches(df, 5).collect()
    assert sum(r.n for r in rows) == 40 and sum(r.mmd is not None for r in rows) == 1
    assert all(r.coverage == 0.0 for r in rows if r.mmd is None)


@pytest.mark.parametrize("n_ref, n_gen", [(300, 12), (9, 300), (150, 140)])
def test_every_event_meets_the_other_side_in_tiles(spark, monkeypatch, n_ref, n_gen):
    monkeypatch.setattr(ds, "_TILE_ROWS", 16)
    rng = np.random.default_rng(n_ref)
    x = np.round(rng.normal(size=(n_ref + n_gen, 3)), 1)  # with ties
    rows = [(i, "ref" if i < n_ref else "gen", [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "event_id bigint, sample string, x array<double>")
    (got,) = ds.coverage_batches(df, 1000).collect()
    x = x / np.abs(x[:n_ref]).max(axis=0)
    d = np.linalg.norm(x[:n_ref, None] - x[None, n_ref:], axis=2)
    assert got.n == n_ref and got.mmd == pytest.approx(d.min(axis=1).mean()) and got.coverage == pytest.approx(len(set(d.argmin(axis=0))) / n_ref)


@pytest.mark.parametrize("d", [3, 64])
def test_tiled_kernels_equal_brute_force(spark, monkeypatch, d):
    monkeypatch.setattr(ds, "_TILE_ROWS", 16)
    monkeypatch.setattr(ds, "_MOST_MONOMIALS", 1)
    df, x = vectors(spark, 120, d)
    which = batches(spark, df, 3)
    x = x / np.abs(x[::2]).max(axis=0)
    got = {r.batch: r.mmd2 for r in ds.kernel_distance_batches(df, 3).collect()}
    for b in range(3):
        m, g = (x[[i for i in range(side, 120, 2) if which[i] == b]] for side in (0, 1))
        k = lambda p, q: (p @ q.T / d + 1) ** 4
        inner = lambda p: (k(p, p).sum() - np.trace(k(p, p))) / (len(p) * (len(p) - 1))
        assert got[b] == pytest.approx(inner(m) + inner(g) - 2 * k(m, g).mean())


def test_odd_samples_are_errors_or_counted(spark):
    df = spark.createDataFrame([("ref", 1.0), ("ref", 2.0), ("gen", 1.5), ("gen", float("inf")), ("gen", None)], "sample string, value double")
    df = df.withColumn("feature", F.lit("f"))
    with pytest.raises(Exception, match="not finite"):
        ds.wasserstein(df, ["feature"]).collect()
    fine, counts = ds.finite_values(df, ["feature"])
    assert {r.sample: (r.n_used, r.n_dropped) for r in counts.collect()} == {"ref": (2, 0), "gen": (1, 2)}
    two = fine.unionByName(spark.createDataFrame([("other", 11.5, "f")], "sample string, value double, feature string"))
    with pytest.raises(ValueError, match="more than one sample"):
        ds.wasserstein(two, ["feature"])
    each = ds.compare_each(two, lambda rows: ds.wasserstein(rows, ["feature"]))
    assert {r.compared: r.w1 for r in each.collect()} == {"gen": pytest.approx(0.5), "other": pytest.approx(10.0)}


def test_kernel_distance_with_single_rows_and_many_features(spark):
    few, _ = vectors(spark, 12, 3)
    row = ds.kpd(few, 10).first()
    assert row.kpd_median is None or np.isfinite(row.kpd_median)
    wide, x = vectors(spark, 24, 36)
    x = x / np.abs(x[::2]).max(axis=0)
    k = (x @ x.T / 36 + 1) ** 4
    a, b = x[::2].shape[0], x[1::2].shape[0]
    inner = [(m.sum() - np.trace(m)) / (n * (n - 1)) for m, n in ((k[::2, ::2], a), (k[1::2, 1::2], b))]
    assert ds.kpd(wide, 1).first().kpd_median == pytest.approx(sum(inner) - 2 * k[::2, 1::2].mean(), rel=1e-6)


def test_event_observables_equal_sums_over_pairs(spark):
    rng = np.random.default_rng(9)
    eta, phi, pt = rng.uniform(-2, 2, 6), rng.uniform(-3, 3, 6), rng.uniform(1, 90, 6)
    jets = spark.createDataFrame([(7, float(a), float(b), float(c)) for a, b, c in zip(eta, phi, pt)] + [(8, 1.0, 1.0, 5.0)],
                                 "event_id bigint, eta double, phi double, pt double")
    theta = 2 * (np.cosh(eta[:, None] - eta) - np.cos(phi[:, None] - phi))
    z = pt / pt.sum()
    got = {r.event_id: r for r in ds.event_features(jets).collect()}
    assert got[7].efp_edge == pytest.approx(z @ theta @ z)
    assert got[7].efp_double == pytest.approx(z @ theta ** 2 @ z)
    assert got[7].efp_wedge == pytest.approx((z * (theta @ z) ** 2).sum())
    assert got[7].mass == pytest.approx(np.sqrt((pt[:, None] * pt * theta).sum() / 2))
    assert (got[8].mass, got[8].efp_edge, got[8].efp_double, got[8].efp_wedge) == (0, 0, 0, 0)


def test_pair_sums(spark):
    df, x = vectors(spark, 60, 5)
    row = ds.sample_pair_sums(df.withColumn("batch", F.lit(0)), ["batch"]).first()
    ref, gen = x[::2], x[1::2]
    assert row.n_pairs == 900 and row.sum_dot == pytest.approx((ref @ gen.T).sum())
    assert row.sum_sq == pytest.approx(((ref[:, None] - gen[None]) ** 2).sum())


def test_monomials_expand_the_kernel():
    exponents, weights = ds._monomials(3, 4)
    x, y = np.array([0.3, -1.2, 0.7]), np.array([1.1, 0.4, -0.6])
    assert (weights * np.prod(x ** exponents, axis=1) * np.prod(y ** exponents, axis=1)).sum() == pytest.approx((x @ y / 3 + 1) ** 4)


def test_metrics_row_of_equal_samples(spark):
    rng = np.random.default_rng(2)
    rows = []
    for event in range(300):
        for _ in range(4):
            eta, phi, pt = (float(v) for v in (rng.uniform(-2, 2), rng.uniform(-3, 3), rng.uniform(1, 50)))
            rows.append(("ref" if event % 2 == 0 else "gen", event, eta, phi, pt))
    row = ds.metrics_row(spark.createDataFrame(rows, "sample string, event_id bigint, eta double, phi double, pt double"), 3, 25, digits=6).first()
    assert len(row) == 14 and 0 < row.coverage <= 1 and abs(row.fpd_value) < 0.5 and row.w1p_avg_eta < 0.5


def test_metrics_make_the_particles_once_and_count_in_hash_maps(spark, monkeypatch):
    from eventspark.operators import distances, events
    from eventspark.plans import fixtures, metrics

    plan = metrics._jets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    particles = fixtures.particles(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, events.valid_events(particles, bounded=True).collect())) == sorted(map(tuple, events.valid_events(particles).collect()))

    seen = []
    monkeypatch.setattr(distances, "ranges", lambda points, *a: seen.append(points) or ordering_ranges(points, *a))
    from eventspark.operators.ordering import ranges as ordering_ranges
    rows = spark.createDataFrame([("ref", "x", 1.0), ("gen", "x", 3.0)], "sample string, feature string, value double")
    assert distances.wasserstein(rows, ["feature"]).first().w1 == 2.0
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="gen, other"):
        distances.wasserstein(rows.union(spark.createDataFrame([("other", "x", 1.0)], rows.schema)), ["feature"])
