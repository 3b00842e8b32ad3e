"""The whole comparison of a generated with a reference sample as one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.functions.binning import Bins
from eventspark.operators import events as ev
from eventspark.operators import histograms as hs

EVENT_FEATURES = ("num_particles", "energy_conservation")


def event_summaries(particles: DataFrame, by: Sequence[str] = ("sample", "event_id")) -> DataFrame:
    """(by..., leading particle, num_particles, energy_conservation): one aggregate over the particles of an event."""
    second = F.col("particle_idx") > 0
    row = F.struct("pdgid", "e", "px", "py", "pz")
    rank = F.when(second & ~F.isnan("e"), F.struct("e", (-F.col("particle_idx")).alias("earliest")))
    e_in, e_out = F.max(F.when(~second, F.col("e"))), F.sum(F.when(second, F.nanvl("e", F.lit(0.0))))
    return particles.groupBy(*by).agg(
        F.max_by(row, rank).alias("lead"), F.count_if(second).cast("double").alias("num_particles"),
        F.abs(e_in - F.coalesce(e_out, F.lit(0.0))).alias("energy_conservation")).select(*by, "lead.*", *EVENT_FEATURES)


def compare_samples(particles: DataFrame, bins: Mapping[str, Bins], samples: Sequence[str], reference: str = "ref") -> DataFrame:
    """(selection, feature, bin, lo, hi, n, densities and errors of both samples, ratio, ratio_err): a row for every bin.

    ``particles`` has (sample, event_id, particle_idx, pdgid, e, px, py, pz). Selections are all secondaries, the leading one
    of each event, and the event itself with its number of secondaries and energy conservation. ``bins`` are by feature;
    empty bins are kept. Particle ids have a bin for each id that either sample has, and no edges. Densities are shares
    of what lies in the bins, per unit of width where there are edges. Particles are scanned twice, for the
    histograms, which are added up before anything is shuffled, and for the events.
    """
    particle_bins = {f: b for f, b in bins.items() if f not in EVENT_FEATURES}
    event_bins = {f: b for f, b in bins.items() if f in EVENT_FEATURES}
    events = event_summaries(particles)
    leading = events.filter(F.col("pdgid").isNotNull())
    parts, counts = (("all", ev.secondaries(particles)), ("leading", leading)), []
    for selection, rows in parts:
        some = ev.with_polar(rows.select("sample", "pdgid", "e", "px", "py", "pz"))
        binned = hs.histogram_many(some, particle_bins, ["sample"]).withColumn("bin", F.col("bin").cast("long"))
        ids = rows.groupBy("sample", F.col("pdgid").alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit("pdgid"))
        counts.append(binned.unionByName(ids).withColumn("selection", F.lit(selection)))
    of_events = hs.histogram_many(events, event_bins, ["sample"]).withColumn("bin", F.col("bin").cast("long"))
    counts.append(of_events.withColumn("selection", F.lit("event")))
    found = counts[0].unionByName(counts[1]).unionByName(counts[2])

    spark, each = particles.sparkSession, F.explode(F.array(*map(F.lit, samples))).alias("sample")
    selections = F.when(F.col("feature").isin(*EVENT_FEATURES), F.array(F.lit("event"))).otherwise(F.array(F.lit("all"), F.lit("leading")))
    grid = hs.bin_grid(spark, bins).select(F.explode(selections).alias("selection"), "feature", F.col("bin").cast("long").alias("bin"), "lo", "hi")
    # which sample counts a row are aggregated once more: both samples of a bin side by side, missing ones 0
    wide = grid.select("*", each).join(found.filter("feature <> 'pdgid'"), ["selection", "feature", "bin", "sample"], "left")
    no = F.lit(None).cast("double")
    ids = found.filter("feature = 'pdgid'")
    ids = (ids.groupBy("selection", "feature", "bin").agg(F.collect_list(F.struct("sample", "n")).alias("c"))  # one row a sample
           .select("selection", "feature", "bin", no.alias("lo"), no.alias("hi"), "c", each)
           .withColumn("n", F.element_at(F.map_from_entries("c"), F.col("sample"))).drop("c"))
    rows = wide.unionByName(ids).withColumn("n", F.coalesce("n", F.lit(0)))
    rows = hs.density(rows, F.coalesce(F.col("hi") - F.col("lo"), F.lit(1.0)), ["selection", "feature", "sample"]).drop("count_err")
    key = ["selection", "feature", "bin", "lo", "hi"]
    of = lambda column, is_ref: F.max(F.when((F.col("sample") == reference) == is_ref, F.col(column)))
    both = rows.groupBy(*key).agg(*[of(c, ref).alias(f"{c}_{side}") for c in ("n", "density", "density_err") for side, ref in (("ref", True), ("gen", False))])
    ratio = F.when(F.col("density_ref") > 0, F.col("density_gen") / F.col("density_ref"))
    error = F.when((F.col("density_ref") > 0) & (F.col("density_gen") > 0), ratio * F.sqrt(1.0 / F.col("n_gen") + 1.0 / F.col("n_ref")))
    return both.withColumns({"ratio": ratio, "ratio_err": error})
