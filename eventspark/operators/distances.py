"""Distances between a reference and a generated sample.

Pair sums factorise: observables over particle pairs come from moment tensors of the event, kernel means
from sums of monomials, so the work is linear in the rows and combines before every shuffle. Only where a
batch has to be compared row by row (nearest neighbours, and kernels of so many features that monomials
outgrow a task) do rows meet, in tiles of a bounded number of rows a side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement
from math import comb, factorial, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators.joins import join_summary
from eventspark.operators.ordering import carried, ranges
from eventspark.schema import METRIC_FIELDS, small_table
from eventspark.scratch import store

EVENT_FEATURES = ("multiplicity", "sum_pt", "mass", "efp_edge", "efp_double", "efp_wedge")
KERNEL_DEGREE = 4
_ROWS_AT_ONCE = 256
_MOST_MONOMIALS = 2000  # beyond, kernels are summed over tiles of rows
_TILE_ROWS = 512        # of a side of a tile, about
_SPREAD = (0.16275, 0.83725)  # central range that a one-sigma error covers


# --- Wasserstein -----------------------------------------------------------------

def _is_finite(value: str) -> Column:
    return F.coalesce(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def finite_values(values: DataFrame, by: Sequence[str], value: str = "value", sample: str = "sample") -> tuple[DataFrame, DataFrame]:
    """The rows with finite values, and how many were used and dropped in each group and sample."""
    counts = values.groupBy(*by, sample).agg(
        F.count_if(_is_finite(value)).alias("n_used"), F.count_if(~_is_finite(value)).alias("n_dropped"))
    return values.filter(_is_finite(value)), counts


def _two_samples(rows: DataFrame, sample: str, reference: str) -> DataFrame:
    """The rows; an error if there are two samples besides the reference, which would be taken as one."""
    others = rows.filter(F.col(sample) != reference).agg(F.min(sample).alias("a"), F.max(sample).alias("b")).first()
    if others["a"] != others["b"]:
        raise ValueError(f"more than one sample beside {reference}: {others['a']}, {others['b']}; compare one at a time")
    return rows


def compare_each(rows: DataFrame, distance, sample: str = "sample", reference: str = "ref") -> DataFrame:
    """``distance`` of the reference and each other sample of ``rows``, with the sample's name in ``compared``.

    There are few samples; each is one run of ``distance`` over its rows and those of the reference.
    """
    out = None
    for row in rows.filter(F.col(sample) != reference).select(sample).distinct().orderBy(sample).collect():
        one = distance(rows.filter(F.col(sample).isin(reference, row[0]))).withColumn("compared", F.lit(row[0]))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no sample beside {reference}")
    return out


def _dimension(vectors: DataFrame) -> int:
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no vectors")
    return first["d"]


def wasserstein(values: DataFrame, by: Sequence[str], value: str = "value", sample: str = "sample",
                reference: str = "ref") -> DataFrame:
    """Area between the two distribution functions, for every group of ``by``.

    Values are counted first, so a value that many rows share is one row when the order is needed. A value
    that is null or not finite is an error, and so is a third sample; ``finite_values`` leaves such values
    out, and a column of ``by`` keeps several generated samples apart.
    """
    is_ref = F.col(sample) == reference
    sound = F.when(_is_finite(value), F.col(value)).otherwise(
        F.raise_error(F.concat(F.lit(f"{value} is not finite in sample "), F.col(sample))).cast("double"))
    other = F.when(~is_ref, F.xxhash64(sample))  # a minimum of text would sort the rows instead of counting in a hash map
    points = values.withColumn(value, sound).groupBy(*by, value).agg(
        F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_gen"), F.min(other).alias("__low"), F.max(other).alias("__high"))
    sums, following = {"upto_ref": F.col("n_ref"), "upto_gen": F.col("n_gen")}, {"next_value": value}
    ranged = ranges(points, [value], by, sums)  # written once: the checks, the totals and the steps read it
    low, high = ranged.agg(F.min("__low"), F.max("__high")).first()
    if low != high:
        _two_samples(values, sample, reference)  # an error with their names
    totals = ranged.groupBy(*by).agg(F.sum("n_ref").alias("all_ref"), F.sum("n_gen").alias("all_gen"))
    steps = carried(ranged, by, None, sums, following, [*by, value])
    gap = F.abs(F.col("upto_ref") / F.col("all_ref") - F.col("upto_gen") / F.col("all_gen"))
    return join_summary(steps, totals, by).groupBy(*by).agg(
        F.sum(gap * (F.col("next_value") - F.col(value))).alias("w1"))


def batch_of(ident: str, n_batches: int, seed: int = 0) -> Column:
    """Batch of a row by a hash of its id: the same on every run and in every partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_batches


def wasserstein_batched(values: DataFrame, by: Sequence[str], ident: str, n_batches: int, seed: int = 0) -> DataFrame:
    """Mean and spread of the distance over batches that together hold every row."""
    batched = values.withColumn("batch", batch_of(ident, n_batches, seed))
    return wasserstein(batched, [*by, "batch"]).groupBy(*by).agg(
        F.avg("w1").alias("w1_mean"), F.stddev_pop("w1").alias("w1_std"))


# --- observables of an event ---------------------------------------------------------

def _directions() -> dict[str, Column]:
    """Light-like direction of a particle for unit pt."""
    return {"t": F.cosh("eta"), "x": F.cos("phi"), "y": F.sin("phi"), "z": F.sinh("eta")}


_AXES = ("t", "x", "y", "z")
_SIGN = {"t": 1.0, "x": -1.0, "y": -1.0, "z": -1.0}


def _without_noise(value: Column, scale: Column) -> Column:
    """0 for what is left when equal terms of the given size cancel."""
    return F.when(F.abs(value) > 1e-12 * scale, value).otherwise(F.lit(0.0))


def _mass_square() -> Column:
    square = sum((F.col(f"p_{a}") ** 2 * _SIGN[a] for a in _AXES), F.lit(0.0))
    return _without_noise(square, F.col("p_t") ** 2)


def jet_mass(jets: DataFrame, by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Invariant mass of the massless particles (pt, eta, phi) of an event."""
    sums = [F.sum(F.col("pt") * d).alias(f"p_{a}") for a, d in _directions().items()]
    return jets.groupBy(*by).agg(*sums).select(*by, F.sqrt(F.greatest(_mass_square(), F.lit(0.0))).alias("mass"))


def _moment_tensors(jets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per event: count, sum of pt, and the pt-weighted first and second moments of the directions."""
    # directions are columns of their own, so that the sums below are plain products
    work = jets.select(*by, "pt", *[d.alias(f"n_{a}") for a, d in _directions().items()])
    weighted = work.select(*by, "pt", *[f"n_{a}" for a in _AXES],
                           *[(F.col("pt") * F.col(f"n_{a}")).alias(f"w_{a}") for a in _AXES])
    return weighted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pt").alias("s"),
        *[F.sum(f"w_{a}").alias(f"p_{a}") for a in _AXES],
        *[F.sum(F.col(f"w_{a}") * F.col(f"n_{b}")).alias(f"t_{a}{b}")
          for a, b in combinations_with_replacement(_AXES, 2)])


def _second(a: str, b: str) -> Column:
    return F.col("t_" + "".join(sorted((a, b), key=_AXES.index)))


def event_features(jets: DataFrame, by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Observables of each event: multiplicity, scalar pt sum, mass and three energy-flow polynomials.

    With the angle theta_ij = 2 (cosh(eta_i - eta_j) - cos(phi_i - phi_j)) and z = pt / sum(pt), the
    polynomials are the sums over particles of z_i z_j theta_ij (edge), z_i z_j theta_ij^2 (double) and
    z_i z_j z_k theta_ij theta_jk (wedge). As theta is a product of four-vectors they are contractions
    of moment tensors (Komiske, Metodiev, Thaler, 2019): linear in the particles. Undefined values are 0.
    """
    square = sum((F.col(f"p_{a}") ** 2 * _SIGN[a] for a in _AXES), F.lit(0.0))
    double = sum((_second(a, b) ** 2 * (_SIGN[a] * _SIGN[b]) for a in _AXES for b in _AXES), F.lit(0.0))
    wedge = sum((_second(a, b) * F.col(f"p_{a}") * F.col(f"p_{b}") * (_SIGN[a] * _SIGN[b])
                 for a in _AXES for b in _AXES), F.lit(0.0))
    raw = _moment_tensors(jets, by).select(
        *by, "n", "s", "p_t", "t_tt", square.alias("square"), double.alias("double"), wedge.alias("wedge"))
    s, t = F.col("s"), F.col("p_t") ** 2
    clean = raw.select(*by, "n", "s", _without_noise(F.col("square"), t).alias("square"),
                       _without_noise(F.col("double"), F.col("t_tt") ** 2).alias("double"),
                       _without_noise(F.col("wedge"), F.col("t_tt") * t).alias("wedge"))
    out = {"multiplicity": F.col("n").cast("double"), "sum_pt": s,
           "mass": F.sqrt(F.greatest(F.col("square"), F.lit(0.0))), "efp_edge": 2.0 * F.col("square") / (s * s),
           "efp_double": 4.0 * F.col("double") / (s * s), "efp_wedge": 4.0 * F.col("wedge") / (s * s * s)}
    return clean.select(*by, *[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(k) for k, c in out.items()])


def event_pair_sums(jets: DataFrame, by: Sequence[str] = ("event_id",)) -> DataFrame:
    """Sums over the particle pairs of an event without building them: the number of pairs, and
    sum pt_i pt_j (cosh(eta_i - eta_j) - cos(phi_i - phi_j)), sum (eta_i - eta_j)^2."""
    t = jets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("pt") * d).alias(f"p_{a}") for a, d in _directions().items()],
        F.sum("eta").alias("e1"), F.sum(F.col("eta") * F.col("eta")).alias("e2"))
    return t.select(*by, F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"),
                    (_mass_square() / 2.0).alias("pair_dot"),
                    (F.col("n") * F.col("e2") - F.col("e1") * F.col("e1")).alias("pair_deta2"))


def as_vectors(features: DataFrame, names: Sequence[str] = EVENT_FEATURES, keep=("event_id", "sample")) -> DataFrame:
    return features.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias("x"))


def scale_by_reference(vectors: DataFrame, reference: str = "ref") -> DataFrame:
    """Divide every feature by its largest absolute value in the reference."""
    d = _dimension(vectors)
    ref = vectors.filter(F.col("sample") == reference)
    top = ref.agg(*[F.max(F.abs(F.get("x", F.lit(i)))).alias(f"m{i}") for i in range(d)]).first()
    scale = [v if v else 1.0 for v in top]
    return vectors.withColumn("x", F.zip_with("x", F.array(*[F.lit(float(s)) for s in scale]), lambda a, b: a / b))


# --- moments ------------------------------------------------------------------------

def _partial_sums(vectors: DataFrame, by: Sequence[str], columns_of) -> DataFrame:
    """Sum over rows of ``columns_of(matrix)`` for every group: (by..., k, s), k = -1 holds the count.

    Each partition adds up its own matrix and emits one short list per group; only those are shuffled.
    """
    keys = list(by)
    fields = [f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.empty:
                continue
            for key, group in batch.groupby(keys, sort=False):
                rows = np.stack(group["x"].to_list())
                # a few rows at a time: their columns may be many
                part = sum(np.concatenate(([len(m)], columns_of(m).sum(axis=0)))
                           for m in (rows[lo:lo + _ROWS_AT_ONCE] for lo in range(0, len(rows), _ROWS_AT_ONCE)))
                sums[key] = sums[key] + part if key in sums else part
        for key, total in sums.items():
            out = pd.DataFrame({"k": np.arange(-1, len(total) - 1, dtype=np.int64), "s": total})
            for name, v in zip(keys, key):
                out[name] = v
            yield out[[*keys, "k", "s"]]

    partial = vectors.select(*keys, "x").mapInPandas(add_up, ", ".join([*fields, "k bigint", "s double"]))
    return partial.groupBy(*keys, "k").agg(F.sum("s").alias("s"))


def _triangle(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(d)


def mean_vector(vectors: DataFrame) -> np.ndarray:
    """Mean of all vectors; d numbers."""
    rows = _partial_sums(vectors.withColumn("__all", F.lit(0)), ["__all"], lambda m: m).orderBy("k").collect()
    total = np.array([r["s"] for r in rows])
    return total[1:] / total[0]


def centered_sums(vectors: DataFrame, by: Sequence[str], center: np.ndarray) -> DataFrame:
    """Count, first and second moments about ``center``: k < d first, then the upper triangle."""
    d = len(center)
    rows, cols = _triangle(d)

    def columns_of(m):
        c = m - center
        return np.hstack([c, c[:, rows] * c[:, cols]])

    return _partial_sums(vectors, by, columns_of)


def feature_mean_cov(vectors: DataFrame, sample: str = "sample") -> DataFrame:
    """Means and sample covariances: (sample, i, j, mean_i, mean_j, cov) for i <= j.

    Moments are taken about the overall mean, so large offsets do not cancel.
    """
    center = mean_vector(vectors)
    d = len(center)
    rows, cols = _triangle(d)
    sums = centered_sums(vectors, [sample], center)
    spark = vectors.sparkSession
    places = small_table(spark, [(int(d + t), int(i), int(j), float(center[i]), float(center[j])) for t, (i, j) in enumerate(zip(rows, cols))],
        "k bigint, i bigint, j bigint, c_i double, c_j double")
    count = sums.filter("k = -1").select(sample, F.col("s").alias("n"))
    first_i = sums.select(sample, F.col("k").alias("i"), F.col("s").alias("s_i"))
    first_j = sums.select(sample, F.col("k").alias("j"), F.col("s").alias("s_j"))
    n = F.col("n")
    return (sums.join(F.broadcast(places), "k").join(count, sample).join(first_i, [sample, "i"]).join(first_j, [sample, "j"])
            .select(sample, "i", "j", (F.col("c_i") + F.col("s_i") / n).alias("mean_i"),
                    (F.col("c_j") + F.col("s_j") / n).alias("mean_j"),
                    ((F.col("s") - F.col("s_i") * F.col("s_j") / n) / (n - 1)).alias("cov")))


def frechet(mean_a, cov_a, mean_b, cov_b) -> float:
    """Distance of two Gaussians; d x d algebra."""
    values, vectors = np.linalg.eigh(cov_a)
    root = (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ cov_b @ root), 0, None)).sum()
    return float(((mean_a - mean_b) ** 2).sum() + np.trace(cov_a) + np.trace(cov_b) - 2 * cross)


def fpd(vectors: DataFrame, n_points: int = 10, seed: int = 0, reference: str = "ref") -> tuple[float, float]:
    """Fréchet distance of features extrapolated to infinite sample size: (value, error).

    Rows fall into ``n_points`` shells by a hash; point k uses the first k shells, so one pass gives the
    moments at every size. Only moments reach the driver.
    """
    scaled = scale_by_reference(vectors, reference)
    center = mean_vector(scaled)
    d = len(center)
    shelled = scaled.withColumn("shell", batch_of("event_id", n_points, seed))
    table: dict[str, np.ndarray] = {}
    width = 1 + d + d * (d + 1) // 2
    for row in centered_sums(shelled, ["sample", "shell"], center).collect():
        side = "ref" if row["sample"] == reference else "gen"
        table.setdefault(side, np.zeros((n_points, width)))[row["shell"], row["k"] + 1] += row["s"]
    upto = {side: t.cumsum(axis=0) for side, t in table.items()}
    sizes, distances = [], []
    for k in range(n_points):
        moments = {}
        for side, t in upto.items():
            n, first, second = t[k, 0], t[k, 1:d + 1], np.zeros((d, d))
            second[_triangle(d)] = t[k, d + 1:]
            second = second + second.T - np.diag(second.diagonal())
            if n > d:
                moments[side] = (first / n, (second - np.outer(first, first) / n) / (n - 1), n)
        if len(moments) == 2:
            (ma, ca, na), (mb, cb, nb) = moments["ref"], moments["gen"]
            sizes.append(min(na, nb))
            distances.append(frechet(ma, ca, mb, cb))
    if len(sizes) < 3:
        return (distances[-1] if distances else float("nan")), float("nan")
    return _intercept(1.0 / np.array(sizes), np.array(distances))


def _intercept(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Straight-line fit: intercept and its standard error."""
    design = np.column_stack([np.ones_like(x), x])
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    left = y - design @ coef
    variance = (left @ left) / max(len(x) - 2, 1)
    return float(coef[0]), float(np.sqrt(variance * np.linalg.inv(design.T @ design)[0, 0]))


# --- kernel distance ----------------------------------------------------------------

def _monomials(d: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponents and weights with sum_a weight_a x^a y^a = (x.y / d + 1)^degree."""
    exponents, weights = [], []
    for picks in combinations_with_replacement(range(d + 1), degree):  # pick 0 stands for the constant 1
        powers = [picks.count(i + 1) for i in range(d)]
        free = degree - sum(powers)
        exponents.append(powers)
        weights.append(factorial(degree) / (factorial(free) * prod(factorial(p) for p in powers)) / d ** sum(powers))
    return np.array(exponents), np.array(weights)


def kernel_sums(vectors: DataFrame, by: Sequence[str], degree: int = KERNEL_DEGREE, reference: str = "ref") -> DataFrame:
    """Kernel sums of every group: pairs inside the reference, inside the generated, and across.

    (x.y / d + 1)^degree is a weighted sum over monomials, so a double sum over rows is a single sum of
    squared monomial totals. The rows' own terms k(x, x) are left out of the inner sums. With so many
    features that monomials outgrow a task, the sum is taken over tiles of pairs instead.
    """
    d = _dimension(vectors)
    if comb(d + degree, degree) > _MOST_MONOMIALS:
        return _tiled_kernel_sums(vectors, by, d, degree, reference)
    exponents, weights = _monomials(d, degree)
    roots = np.sqrt(weights)

    def columns_of(m):
        powers = m[:, None, :] ** np.arange(degree + 1)[None, :, None]  # rows x power x feature
        phi = np.ones((len(m), len(weights))) * roots
        for i in range(d):
            phi *= powers[:, exponents[:, i], i]
        own = ((m * m).sum(axis=1) / d + 1.0) ** degree
        return np.column_stack([own, phi])

    sums = _partial_sums(vectors, [*by, "sample"], columns_of)
    is_ref = F.col("sample") == reference
    wide = sums.groupBy(*by, "k").agg(F.sum(F.when(is_ref, F.col("s"))).alias("a"),
                                      F.sum(F.when(~is_ref, F.col("s"))).alias("b"))
    phi = F.col("k") > 0

    def only(k, c):
        return F.max(F.when(F.col("k") == k, F.col(c)))

    return wide.groupBy(*by).agg(
        only(-1, "a").alias("n_ref"), only(-1, "b").alias("n_gen"),
        (F.sum(F.when(phi, F.col("a") * F.col("a"))) - only(0, "a")).alias("k_ref"),
        (F.sum(F.when(phi, F.col("b") * F.col("b"))) - only(0, "b")).alias("k_gen"),
        F.sum(F.when(phi, F.col("a") * F.col("b"))).alias("k_cross"))


def _tiled_kernel_sums(vectors: DataFrame, by: Sequence[str], d: int, degree: int, reference: str) -> DataFrame:
    """``kernel_sums`` over tiles: a hash deals the rows of a group to strips, and each pair of strips is one
    matrix of products. A task holds two strips and their matrix, whatever the numbers of rows and features."""
    keys = list(by)
    most = vectors.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    strips = max(1, -(-most // _TILE_ROWS))
    own = F.pmod(F.xxhash64(*vectors.columns), F.lit(strips)).cast("int")
    dealt = vectors.select(*keys, "sample", "x", own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")
    names = ["n_ref", "n_gen", "k_ref", "k_gen", "k_cross"]

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        x, is_ref = np.stack(group["x"].to_list()), (group["sample"] == reference).to_numpy()
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        if lo == hi:
            k = (x @ x.T / d + 1.0) ** degree
            np.fill_diagonal(k, 0.0)
            a = b = is_ref
            sums = [a.sum(), (~a).sum(), k[np.ix_(a, a)].sum(), k[np.ix_(~a, ~a)].sum(), k[np.ix_(a, ~a)].sum()]
        else:
            first = (group["own"] == lo).to_numpy()
            k, a, b = (x[first] @ x[~first].T / d + 1.0) ** degree, is_ref[first], is_ref[~first]
            sums = [0, 0, 2 * k[np.ix_(a, b)].sum(), 2 * k[np.ix_(~a, ~b)].sum(), k[np.ix_(a, ~b)].sum() + k[np.ix_(~a, b)].sum()]
        return pd.DataFrame({key: group[key].iloc[:1].to_numpy() for key in keys} | {n: [float(v)] for n, v in zip(names, sums)})

    fields = [f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in names]
    tiles = dealt.groupBy(*keys, "lo", "hi").applyInPandas(tile, ", ".join(fields))
    return tiles.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def kernel_distance_batches(vectors: DataFrame, n_batches: int = 10, seed: int = 0) -> DataFrame:
    """Unbiased squared kernel distance in every batch; null where a side has fewer than two rows."""
    batched = scale_by_reference(_two_samples(vectors, "sample", "ref")).withColumn("batch", batch_of("event_id", n_batches, seed))
    n, m = F.col("n_ref"), F.col("n_gen")
    return kernel_sums(batched, ["batch"]).select("batch", (
        F.try_divide("k_ref", n * (n - 1)) + F.try_divide("k_gen", m * (m - 1)) - 2.0 * F.try_divide("k_cross", n * m)).alias("mmd2"))


def kpd(vectors: DataFrame, n_batches: int = 10, seed: int = 0) -> DataFrame:
    """Median over the batches with a distance and half the central one-sigma range."""
    low, high = _SPREAD
    return kernel_distance_batches(vectors, n_batches, seed).agg(
        F.percentile("mmd2", F.lit(0.5)).alias("kpd_median"),
        ((F.percentile("mmd2", F.lit(high)) - F.percentile("mmd2", F.lit(low))) / 2.0).alias("kpd_error"))


def sample_pair_sums(vectors: DataFrame, by: Sequence[str], reference: str = "ref") -> DataFrame:
    """Over all reference x generated pairs of a group: their number, sum of dot products and sum of
    squared distances, from sums of each side. No pair is built."""
    def columns_of(m):
        return np.column_stack([(m * m).sum(axis=1), m])

    sums = _partial_sums(vectors, [*by, "sample"], columns_of)
    is_ref = F.col("sample") == reference
    wide = sums.groupBy(*by, "k").agg(F.sum(F.when(is_ref, F.col("s"))).alias("a"),
                                      F.sum(F.when(~is_ref, F.col("s"))).alias("b"))

    def only(k, c):
        return F.max(F.when(F.col("k") == k, F.col(c)))

    dot = F.sum(F.when(F.col("k") > 0, F.col("a") * F.col("b")))
    return wide.groupBy(*by).agg(
        (only(-1, "a") * only(-1, "b")).cast("long").alias("n_pairs"), dot.alias("sum_dot"),
        (only(-1, "b") * only(0, "a") + only(-1, "a") * only(0, "b") - 2.0 * dot).alias("sum_sq"))


# --- coverage -----------------------------------------------------------------------

def coverage_batches(vectors: DataFrame, batch_size: int = 100, seed: int = 0) -> DataFrame:
    """Coverage and mean nearest distance in batches of about ``batch_size`` events of the smaller sample.

    Coverage is the share of reference events that are nearest to some generated one; the other value
    is the mean distance of a reference event to its nearest generated one. A hash of the event gives its
    batch, so every event of either sample meets the other side of its batch, whatever the samples' sizes. A
    side with many events is dealt to tiles, which meet the tiles of the other side; nearest events are
    combined as minima, so no task holds more than two tiles. A batch without generated events covers nothing
    and has no distance; one without reference events has no row.
    """
    scaled = scale_by_reference(_two_samples(vectors, "sample", "ref"))
    sizes = {row["is_ref"]: row["count"] for row in scaled.groupBy((F.col("sample") == "ref").alias("is_ref")).count().collect()}
    batches = max(1, -(-min(sizes.values(), default=0) // batch_size))
    n_ref, n_gen = (max(1, -(-sizes.get(side, 0) // (batches * _TILE_ROWS))) for side in (True, False))
    is_ref = F.col("sample") == "ref"

    def strip(n, salt):
        return F.pmod(F.xxhash64(F.lit(salt), "event_id"), F.lit(n)).cast("int")

    def everywhere(n):
        return F.sequence(F.lit(0), F.lit(n - 1))

    dealt = scaled.select(batch_of("event_id", batches, seed).alias("batch"), is_ref.alias("is_ref"), "event_id", "x").select(
        "*", F.explode(F.when(F.col("is_ref"), F.array(strip(n_ref, 1))).otherwise(everywhere(n_ref))).alias("a")).select(
        "*", F.explode(F.when(F.col("is_ref"), everywhere(n_gen)).otherwise(F.array(strip(n_gen, 2)))).alias("b"))

    def nearest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("event_id")
        x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        side = group["is_ref"].to_numpy()
        places = [np.flatnonzero(side), np.flatnonzero(~side)]
        ids = [group["event_id"].take(pa.array(k)) for k in places]
        ref, gen = (x[k] for k in places)
        d, at = [np.full(len(ref), np.inf)], [ids[0]]
        if len(ref) and len(gen):
            distance = np.empty((len(ref), len(gen)))
            for lo in range(0, len(ref), 16):
                distance[lo:lo + 16] = np.sqrt(((ref[lo:lo + 16, None, :] - gen[None, :, :]) ** 2).sum(axis=2))
            d = [distance.min(axis=1), distance.min(axis=0)]
            at.append(ids[0].take(pa.array(distance.argmin(axis=0))))
        found, n = ids[:len(d)], sum(map(len, d))
        return pa.table({"batch": group["batch"][:1].take(pa.array(np.zeros(n, np.int64))), "is_ref": np.arange(n) < len(ref),
                         "event_id": pa.chunked_array([c for f in found for c in f.chunks], group["event_id"].type), "d": np.concatenate(d),
                         "at": pa.chunked_array([c for f in at for c in f.chunks], group["event_id"].type)})

    ident = scaled.schema["event_id"].dataType.simpleString()
    partial = dealt.groupBy("batch", "a", "b").applyInArrow(nearest, f"batch bigint, is_ref boolean, event_id {ident}, d double, at {ident}")
    best = partial.groupBy("batch", "is_ref", "event_id").agg(F.min(F.struct("d", "at")).alias("near"))
    hit, own = F.when(~F.col("is_ref"), F.col("near.at")), F.when(F.col("is_ref"), F.col("near.d"))
    found = best.groupBy("batch").agg(F.count_if("is_ref").alias("n"), F.count_distinct(hit).alias("hit"), F.avg(own).alias("mmd"))
    return found.filter("n > 0").select("batch", "n", (F.col("hit") / F.col("n")).alias("coverage"),
                                        F.when(F.col("mmd") < float("inf"), F.col("mmd")).alias("mmd"))


def coverage_mmd(vectors: DataFrame, batch_size: int = 100, seed: int = 0) -> DataFrame:
    """Means over the batches, each weighted by its events."""
    n = F.col("n")
    return coverage_batches(vectors, batch_size, seed).agg(
        (F.sum(F.col("coverage") * n) / F.sum(n)).alias("coverage"),
        (F.sum(F.col("mmd") * n) / F.sum(F.when(F.col("mmd").isNotNull(), n))).alias("mmd"))


# --- the whole row ------------------------------------------------------------------

def significant(x: float, digits: int = 6) -> float:
    return float(f"{x:.{digits}g}")


def metrics_row(jets: DataFrame, n_batches: int = 10, batch_size: int = 100, seed: int = 0,
                digits: int | None = None) -> DataFrame:
    """All comparison metrics as one row. ``jets`` has (sample, event_id, eta, phi, pt)."""
    jets = store(jets.select("sample", "event_id", "eta", "phi", "pt"), "jets")
    features = store(event_features(jets, ("sample", "event_id")), "features")
    vectors = as_vectors(features)
    found: dict[str, float] = {}
    found |= coverage_mmd(vectors, batch_size, seed).first().asDict()
    found |= kpd(vectors, n_batches, seed).first().asDict()
    found["fpd_value"], found["fpd_error"] = fpd(vectors, n_batches, seed)
    mass = features.select("sample", "event_id", F.lit("mass").alias("feature"), F.col("mass").alias("value"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("eta", "phi", "pt")])
    long = jets.select("sample", "event_id", F.inline(pairs)).unionByName(mass)
    for row in wasserstein_batched(long, ["feature"], "event_id", n_batches, seed).collect():
        name = "w1m_score" if row["feature"] == "mass" else f"w1p_avg_{row['feature']}"
        found[name], found[f"{name}_std"] = row["w1_mean"], row["w1_std"]
    values = [float("nan") if found.get(f) is None else found[f] for f in METRIC_FIELDS]
    if digits:
        values = [significant(v, digits) for v in values]
    return small_table(jets.sparkSession, [tuple(values)], ", ".join(f"{f} double" for f in METRIC_FIELDS))
