"""Histograms, category frequencies, densities with Poisson errors, ratios of samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventspark.functions.binning import Bins, bins_table, bucketize
from eventspark.schema import small_table

# Usual histogram ranges (low, high, bins) of the analysis variables.
DEFAULT_RANGES: dict[str, tuple[float, float, int]] = {
    "num_particles": (-0.5, 50.5, 51),
    "energy_conservation": (0.0, 45000.0, 41),
    "e": (0.0, 35000.0, 70),
    "px": (-5000.0, 35000.0, 70),
    "py": (-5000.0, 35000.0, 70),
    "pz": (-5000.0, 35000.0, 70),
}


def in_range(value: Column, bins: Bins) -> Column:
    """Inside the edges; the last bin is closed."""
    return (value >= bins.edges[0]) & (value <= bins.edges[-1])


def histogram(values: DataFrame, bins: Bins, samples: Sequence[str], value: str = "value",
              sample: str = "sample") -> DataFrame:
    """Counts of every bin for every sample, empty bins kept: (bin, lo, hi, center, sample, n)."""
    inside = bucketize(values.filter(in_range(F.col(value), bins)), value, bins, "bin")
    counted = inside.groupBy("bin", sample).agg(F.count(F.lit(1)).alias("n"))
    grid = bins_table(values.sparkSession, bins).withColumn(
        sample, F.explode(F.array(*[F.lit(s) for s in samples])))
    return (grid.join(counted, ["bin", sample], "left")
            .select("bin", "lo", "hi", "center", sample, F.coalesce("n", F.lit(0)).alias("n")))


def density(counts: DataFrame, width: Column | None = None, by: Sequence[str] = ("sample",)) -> DataFrame:
    """Share (per unit width when given) and its Poisson error; an empty sample gives 0.

    The window runs over histogram rows, never over data.
    """
    total = F.sum("n").over(Window.partitionBy(*by))
    scale = total * (width if width is not None else F.lit(1.0))
    n = F.col("n")
    return counts.withColumns({
        "density": F.when(total > 0, n / scale).otherwise(F.lit(0.0)),
        "density_err": F.when(total > 0, F.sqrt(n) / scale).otherwise(F.lit(0.0)),
        "count_err": F.sqrt(n)})


def ratio(counts: DataFrame, key: Sequence[str], reference: str, by: Sequence[str] = (),
          sample: str = "sample", limits: tuple[float, float] | None = None) -> DataFrame:
    """Generated over reference shares with the propagated error.

    No ratio where the reference is empty, no error where either is; flags mark ratios beyond the limits.
    """
    # the reference row comes by a window over histogram rows, so the counts are computed once
    same_key = Window.partitionBy(*by, *key)

    def of_reference(column):
        return F.max(F.when(F.col(sample) == reference, F.col(column))).over(same_key)

    gen = density(counts, by=(*by, sample)).withColumns({
        "n_ref": of_reference("n"), "d_ref": of_reference("density"), "e_ref": of_reference("density_err"),
    }).filter(F.col(sample) != reference).select(
        *by, *key, sample, "n_ref", "d_ref", "e_ref", F.col("n").alias("n_gen"),
        F.col("density").alias("d_gen"), F.col("density_err").alias("e_gen"))
    value = F.when(F.col("d_ref") > 0, F.col("d_gen") / F.col("d_ref"))
    relative = F.sqrt((F.col("e_gen") / F.col("d_gen")) ** 2 + (F.col("e_ref") / F.col("d_ref")) ** 2)
    out = gen.withColumn("ratio", value).withColumn(
        "ratio_err", F.when((F.col("d_gen") > 0) & (F.col("d_ref") > 0), F.col("ratio") * relative))
    if limits:
        low, high = limits
        out = out.withColumns({"above": F.coalesce(F.col("ratio") > high - 0.01, F.lit(False)),
                               "below": F.coalesce(F.col("ratio") < low + 0.01, F.lit(False))})
    return out.drop("e_gen", "e_ref")


def category_counts(values: DataFrame, category: str, samples: Sequence[str], sample: str = "sample") -> DataFrame:
    """Counts of every sample on the union of categories, missing = 0: one column for each sample."""
    counted = values.groupBy(category, sample).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(category).agg(*[
        F.coalesce(F.sum(F.when(F.col(sample) == s, F.col("n"))), F.lit(0)).alias(s) for s in samples])


def category_top(counts: DataFrame, category: str, reference: str, k: int) -> DataFrame:
    """The k categories most frequent in the reference, ties by category."""
    return counts.orderBy(F.desc(reference), category).limit(k)


def long_counts(counts: DataFrame, category: str, samples: Sequence[str], sample: str = "sample") -> DataFrame:
    """Wide category counts -> (category, sample, n)."""
    return counts.unpivot([category], list(samples), sample, "n")


def category_density(values: DataFrame, category: str, samples: Sequence[str], sample: str = "sample") -> DataFrame:
    return density(long_counts(category_counts(values, category, samples, sample), category, samples, sample),
                   by=(sample,))


def category_union(left: DataFrame, right: DataFrame, category: str) -> DataFrame:
    """Distinct categories of both; each side is reduced before the union."""
    return left.select(category).distinct().union(right.select(category).distinct()).distinct()


def stacked(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wide -> (keep..., feature, value), narrow projection without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*keep, F.inline(pairs))


def histogram_many(rows: DataFrame, bins: Mapping[str, Bins], by: Sequence[str]) -> DataFrame:
    """Histograms of many columns at once: one scan and one groupBy over (by..., feature, bin).

    The bins are computed next to each other in the wide row and stacked afterwards, so the shuffle
    carries nothing but bin counts. Empty bins have no row here.
    """
    # outside values get a negative bin: without branches the generated code stays small
    binned = rows.select(*by, *[
        (b.index(F.col(name)) - (~in_range(F.col(name), b)).cast("int") * (b.count + 1)).alias(name)
        for name, b in bins.items()])
    return (binned.unpivot(list(by), list(bins), "feature", "bin").filter("bin >= 0")
            .groupBy(*by, "feature", "bin").agg(F.count(F.lit(1)).alias("n")))


def bin_grid(spark: SparkSession, bins: Mapping[str, Bins]) -> DataFrame:
    """All (feature, bin) pairs with their edges."""
    rows = [(f, i, lo, hi) for f, b in bins.items() for i, (lo, hi) in enumerate(zip(b.edges, b.edges[1:]))]
    return small_table(spark, rows, "feature string, bin int, lo double, hi double")


def values_with_bin(values: DataFrame, value: str, bins: Bins) -> DataFrame:
    """Range join of values and bins as an equi join: the bin number is computed, then verified.

    Values outside the edges have no bin and drop out, as in the theta join ``lo <= v < hi``.
    """
    table = bins_table(values.sparkSession, bins)
    numbered = bucketize(values, value, bins, "bin")
    return numbered.join(F.broadcast(table), "bin").filter(
        (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))


def bin_means(values: DataFrame, value: str, bins: Bins) -> DataFrame:
    """Mean of the values in each left-open bin, the center where there is none."""
    table = bins_table(values.sparkSession, bins)
    found = values.withColumn("bin", bins.index_left_open(F.col(value))).groupBy("bin").agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return table.join(found, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", "center").alias("mean"))
