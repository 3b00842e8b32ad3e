"""Events and particles: reshaping, selection, validation and per-event quantities.

The long form (one row for each particle) carries the operators: aggregates over an event combine on
the map side, so an event of any size is no hot spot. The nested form (one row for each event, as in
the text files) needs no shuffle at all for whatever looks at one event only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventspark.functions import kinematics as kin
from eventspark.operators.ordering import running, with_position
from eventspark.schema import ETA_LIMIT, RAW_FIELDS, TARGET_MASS, VERBOSE_FIELDS
from eventspark.scratch import store


# --- shape -------------------------------------------------------------------

def explode_events(events: DataFrame) -> DataFrame:
    """Nested -> long, with the place of the particle in its event."""
    keep = [c for c in events.columns if c != "particles"]
    return events.select(*keep, F.posexplode("particles").alias("particle_idx", "p")).select(
        *keep, F.col("particle_idx").cast("long").alias("particle_idx"), "p.*")


def nest_events(particles: DataFrame, fields=RAW_FIELDS) -> DataFrame:
    """Long -> nested in particle order. An event is one row of the data model."""
    row = F.struct("particle_idx", *fields)
    return particles.groupBy("event_id").agg(F.sort_array(F.collect_list(row)).alias("ordered")).select(
        "event_id", F.transform("ordered", lambda p: F.struct(*[p[f].alias(f) for f in fields])).alias("particles"))


# --- kinematics --------------------------------------------------------------

def with_polar(particles: DataFrame) -> DataFrame:
    """Add pt, eta, theta, phi."""
    return particles.withColumns(kin.polar(F.col("px"), F.col("py"), F.col("pz")))


def to_features(particles: DataFrame, fill: float | None = None) -> DataFrame:
    """Four-vectors -> (pdgid, pt, eta, phi); ``fill`` replaces undefined values."""
    angles = kin.polar(F.col("px"), F.col("py"), F.col("pz"))
    if fill is not None:
        angles = {k: F.nanvl(v, F.lit(fill)) for k, v in angles.items()}
    return particles.select("event_id", "particle_idx", "pdgid",
                            *[angles[k].alias(k) for k in ("pt", "eta", "phi")])


def with_encoder_variables(particles: DataFrame) -> DataFrame:
    return particles.withColumns(kin.encoder_variables(F.col("px"), F.col("py"), F.col("pz")))


def jet_view(particles: DataFrame) -> DataFrame:
    """(eta, phi, pt) of every particle, the input order of the metrics."""
    return to_features(particles).select("event_id", "particle_idx", "eta", "phi", "pt")


def with_mass(particles: DataFrame, pdg: DataFrame, on_missing: str = "error") -> DataFrame:
    """Attach the particle mass; the particle table is a bounded dimension.

    ``on_missing``: "error", "reject" (drop the particle) or "null".
    """
    joined = particles.join(pdg.select("pdgid", "mass"), "pdgid", "inner" if on_missing == "reject" else "left")
    if on_missing == "error":
        text = F.concat(F.lit("no mass for particle id "), F.col("pdgid").cast("string"))
        joined = joined.withColumn("mass", F.coalesce("mass", F.raise_error(text).cast("double")))
    elif on_missing not in ("reject", "null"):
        raise ValueError(f"unknown on_missing {on_missing!r}")
    return joined.select(*particles.columns, "mass")


def four_vectors(features: DataFrame) -> DataFrame:
    """Reconstruct (e, px, py, pz) from the features and the mass column, whichever set is complete."""
    have = {f: F.col(f) for f in VERBOSE_FIELDS[1:] if f in features.columns}
    vector = kin.four_vector(F.col("mass") if "mass" in features.columns else F.lit(None), have)
    return features.select("event_id", "particle_idx", "pdgid",
                           *[vector[f].alias(f) for f in ("e", "px", "py", "pz")])


# --- selection ---------------------------------------------------------------

def _encodable(p: Column | None = None, eta_limit: float = ETA_LIMIT) -> Column:
    get = F.col if p is None else p.__getitem__
    return kin.encodable(get("e"), get("px"), get("py"), get("pz"), eta_limit)


def valid_events(particles: DataFrame, eta_limit: float = ETA_LIMIT, bounded: bool = False) -> DataFrame:
    """Drop every event that has a particle the encoder refuses.

    The refused events are a pre-aggregated key list; the anti join leaves the particles where they
    are when that list is small and splits hot events when it is not. ``bounded`` promises that no event
    outgrows a task: particles that lie together by event are then neither made nor sorted a second time.
    """
    if bounded:
        refuses = F.coalesce(~_encodable(eta_limit=eta_limit), F.lit(False))
        flagged = particles.withColumn("__refused", F.max(refuses).over(Window.partitionBy("event_id")))
        return flagged.filter(~F.col("__refused") | F.col("event_id").isNull()).drop("__refused")  # null meets nothing in the join either
    refused = particles.filter(~_encodable(eta_limit=eta_limit)).select("event_id").distinct()
    return particles.join(refused, "event_id", "left_anti")


def valid_nested_events(events: DataFrame, eta_limit: float = ETA_LIMIT) -> DataFrame:
    """The same on nested events: one row decides for itself, no shuffle."""
    return events.filter(F.forall("particles", lambda p: _encodable(p, eta_limit)))


def secondaries(particles: DataFrame) -> DataFrame:
    """Without the incident particle."""
    return particles.filter("particle_idx > 0")


def multiplicity_filter(events: DataFrame, smallest: int, largest: int, truncate: bool = False) -> DataFrame:
    """Nested events with a bounded number of particles: others dropped, or long ones cut."""
    n = F.size("particles")
    if truncate:
        return events.filter(n >= smallest).withColumn("particles", F.slice("particles", 1, largest))
    return events.filter(n.between(smallest, largest))


def first_events(events: DataFrame, n: int) -> DataFrame:
    """The first n events by id; a pushed-down range, no sort."""
    return events.filter(F.col("event_id") < n)


def match_counts(events: DataFrame, sample: str = "sample", order: str = "event_id") -> DataFrame:
    """Cut the samples to the size of the smallest one, in event order."""
    events = store(events, "matched")  # three passes follow
    smallest = events.groupBy(sample).count().agg(F.min("count")).first()[0] or 0
    return with_position(events, [order], [sample], "__place").filter(F.col("__place") < smallest).drop("__place")


# --- per event ---------------------------------------------------------------

def multiplicity(particles: DataFrame, by=("event_id",)) -> DataFrame:
    """Secondaries of every event; events with the incident particle only count 0."""
    return particles.groupBy(*by).agg(F.count_if(F.col("particle_idx") > 0).alias("num_particles"))


def leading_particle(particles: DataFrame, fields=RAW_FIELDS, by=("event_id",)) -> DataFrame:
    """Secondary of the highest energy, the first of equals. An aggregate, so nothing is sorted."""
    rank = F.struct("e", (-F.col("particle_idx")).alias("earliest"))
    row = F.struct("particle_idx", *fields)
    return (secondaries(particles).filter("not isnan(e)").groupBy(*by)
            .agg(F.max_by(row, rank).alias("p")).select(*by, "p.*"))


def energy_balance(particles: DataFrame, by=("event_id",)) -> DataFrame:
    """|incident energy - sum of secondary energies|; NaN energies are skipped in the sum."""
    first = F.col("particle_idx") == 0
    return particles.groupBy(*by).agg(
        F.max(F.when(first, F.col("e"))).alias("e_in"),
        F.coalesce(F.sum(F.when(~first, F.nanvl("e", F.lit(0.0)))), F.lit(0.0)).alias("e_out"),
    ).withColumn("energy_balance", F.abs(F.col("e_in") - F.col("e_out")))


def system_energies(particles: DataFrame, pdg: DataFrame, target_mass: float = TARGET_MASS,
                    by=("event_id",)) -> DataFrame:
    """Energy of incident particle plus target at rest, and of the outgoing particles' vector sum.

    Energies are rebuilt from momentum and mass; the energy of a vector sum is the sum of energies.
    """
    massive = with_mass(particles, pdg)
    energy = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2 + F.col("mass") ** 2)
    first = F.col("particle_idx") == 0
    return massive.groupBy(*by).agg(
        (F.max(F.when(first, energy)) + F.lit(target_mass)).alias("e_in"),
        F.coalesce(F.sum(F.when(~first, energy)), F.lit(0.0)).alias("e_out"))


def extract_column(particles: DataFrame, column: str, leading: bool = False, by=("event_id",)) -> DataFrame:
    """One analysis variable as ``value``: over all secondaries, of the leading one, or num_particles."""
    if column == "num_particles":
        return multiplicity(particles, by).withColumnRenamed("num_particles", "value")
    source = particles if column in particles.columns else with_polar(particles)
    if leading:
        fields = list(dict.fromkeys(["e", column]))
        return leading_particle(source, fields, by).select(*by, F.col(column).alias("value"))
    return secondaries(source).select(*by, "particle_idx", F.col(column).alias("value")).filter(
        "value is not null and not isnan(value)")


def multiplicity_stats(particles: DataFrame, sample: str = "sample") -> DataFrame:
    """Mean and spread of the multiplicity in each sample."""
    return multiplicity(particles, (sample, "event_id")).groupBy(sample).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("num_particles").alias("mean"),
        F.stddev_pop("num_particles").alias("std"))


def profile(events: DataFrame) -> DataFrame:
    """Number of events and the largest particle count."""
    return events.agg(F.count(F.lit(1)).alias("num_events"),
                      F.coalesce(F.max(F.size("particles")), F.lit(0)).cast("long").alias("num_particles_max"))


# --- particle ids ------------------------------------------------------------

def pdgid_occurrences(particles: DataFrame) -> DataFrame:
    """(pdgid, event_id) pairs with the number of particles. Stands for the per-id event lists,
    which would gather most of the events in one row for a common id."""
    return (particles.filter("pdgid is not null and pdgid <> 0")
            .groupBy("pdgid", "event_id").agg(F.count(F.lit(1)).alias("n")))


def pdgid_frequency(particles: DataFrame) -> DataFrame:
    """Particles and events of every id; combined by (id, event) first, then by id."""
    return pdgid_occurrences(particles).groupBy("pdgid").agg(
        F.sum("n").alias("n_particles"), F.count(F.lit(1)).alias("n_events"))


def rarest_ids(particles: DataFrame, n: int) -> DataFrame:
    """The n ids found in the fewest events, ties by id."""
    return pdgid_frequency(particles).orderBy("n_events", "pdgid").limit(n)


def events_with_rarest(particles: DataFrame, n: int) -> DataFrame:
    """Events lost when the n rarest ids are removed."""
    return particles.join(rarest_ids(particles, n).select("pdgid"), "pdgid", "left_semi") \
        .select("event_id").distinct()


def events_without_rarest(particles: DataFrame, n: int) -> DataFrame:
    """Events that survive the removal of the n rarest ids."""
    events = particles.select("event_id").distinct()
    return events.join(events_with_rarest(particles, n), "event_id", "left_anti")


def max_removable_ids(particles: DataFrame, budget: int) -> DataFrame:
    """How many of the rarest ids can go within a budget of lost events, in one pass.

    An event is lost as soon as its rarest id is: count events by the rank of their rarest id and add up.
    Ordered windows run over distinct ids only.
    """
    occurrences = store(pdgid_occurrences(particles), "occurrences")
    frequency = occurrences.groupBy("pdgid").agg(F.count(F.lit(1)).alias("n_events"))
    ranks = store(with_position(frequency, ["n_events", "pdgid"], name="rank").select("pdgid", "rank"), "ranks")
    lost_at = (occurrences.join(ranks, "pdgid").groupBy("event_id")
               .agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("lost")))
    steps = running(ranks.select("rank").join(lost_at, "rank", "left").fillna(0, ["lost"]),
                    ["rank"], sums={"lost_so_far": F.col("lost")})
    # removing every id is not considered: at most all but the last
    return steps.agg(F.least(
        F.count_if(F.col("lost_so_far") <= budget), F.greatest(F.count(F.lit(1)) - 1, F.lit(0))
    ).alias("n_removable"))
