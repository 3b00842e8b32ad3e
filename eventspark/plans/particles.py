"""Queries on particles and events: kinematics, selection, per-event quantities, particle ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.operators import events as ev
from eventspark.operators import training_runs as runs
from eventspark.plans import fixtures as fx


def r(col, digits=6):
    """Rounded for comparison; adding 0 turns -0 into 0."""
    return F.round(col, digits) + 0.0


def rounded(df, names, digits=6):
    return df.withColumns({n: r(F.col(n), digits) for n in names})


def rs(names, digits=6, prefix=""):
    return ", ".join(f"round({prefix}{n}, {digits}) + 0.0e0 as {n}" for n in names)


ID = ("event_id", "particle_idx")


def kin_polar(spark, sf):
    p = ev.with_polar(fx.particles(spark, sf))
    return rounded(p.select(*ID, "pt", "eta", "theta", "phi"), ["pt", "eta", "theta", "phi"])


def kin_verbose(spark, sf):
    p = ev.with_polar(fx.particles(spark, sf))
    return rounded(p, ["e", "px", "py", "pz", "pt", "eta", "theta", "phi"])


def kin_features(spark, sf):
    return rounded(ev.to_features(fx.particles(spark, sf), fill=0.0), ["pt", "eta", "phi"])


def kin_encode_vars(spark, sf):
    p = ev.with_encoder_variables(fx.particles(spark, sf))
    return rounded(p.select(*ID, "pt", "eta", "theta", "phi"), ["pt", "eta", "theta", "phi"])


def _features_with_mass(spark, sf):
    return ev.with_mass(ev.with_encoder_variables(fx.particles(spark, sf)), fx.pdg(spark))


VECTOR = ["e", "px", "py", "pz"]


def kin_from_pt_eta_phi(spark, sf):
    p = _features_with_mass(spark, sf).select(*ID, "pdgid", "pt", "eta", "phi", "mass")
    return rounded(ev.four_vectors(p), VECTOR, 4)


def kin_from_e_theta_phi(spark, sf):
    p = _features_with_mass(spark, sf).select(*ID, "pdgid", "e", "theta", "phi", "mass")
    return rounded(ev.four_vectors(p), VECTOR, 4)


def kin_from_cartesian(spark, sf):
    p = fx.particles(spark, sf).select(*ID, "pdgid", *VECTOR)
    return rounded(ev.four_vectors(p), VECTOR, 4)


def jet_view(spark, sf):
    return rounded(ev.jet_view(fx.particles(spark, sf)), ["eta", "phi", "pt"])


def explode_events(spark, sf):
    p = ev.explode_events(ev.nest_events(fx.particles(spark, sf)))
    return rounded(p.select(*ID, "pdgid", "e"), ["e"])


def nest_events(spark, sf):
    text = F.array_join(F.transform("particles", lambda p: F.concat_ws(
        ":", p["pdgid"], F.round(p["pz"] * 1000).cast("long"))), ";")
    return ev.nest_events(fx.particles(spark, sf)).select("event_id", text.alias("particles"))


def epoch_of_iter(spark, sf):
    return runs.with_epoch(fx.training_log(spark, sf), 64).select(
        "model", "iter", "epoch", "iter_in_epoch", r(F.col("epoch_fraction")).alias("epoch_fraction"))


def valid_events(spark, sf):
    return ev.valid_events(fx.particles(spark, sf)).select(*ID, "pdgid")


def valid_nested_events(spark, sf):
    return ev.valid_nested_events(ev.nest_events(fx.particles(spark, sf))).select(
        "event_id", F.size("particles").cast("long").alias("n_particles"))


def drop_incident(spark, sf):
    return rounded(ev.secondaries(fx.particles(spark, sf)).select(*ID, "pdgid", "e"), ["e"])


def event_multiplicity_filter(spark, sf):
    """Both modes: events outside 3..6 dropped, or longer ones cut to 6 particles."""
    events = ev.nest_events(fx.particles(spark, sf))
    cut = ev.multiplicity_filter(events, 3, 6, truncate=True).withColumn("mode", F.lit("cut"))
    dropped = ev.multiplicity_filter(events, 3, 6).withColumn("mode", F.lit("drop"))
    return cut.unionByName(dropped).select(
        "mode", "event_id", F.size("particles").cast("long").alias("n_particles"),
        r(F.aggregate("particles", F.lit(0.0), lambda acc, p: acc + p["pz"]), 3).alias("pz_sum"))


def first_n_events(spark, sf):
    return rounded(ev.first_events(fx.particles(spark, sf), 5000).select(*ID, "pdgid", "e"), ["e"])


def match_counts(spark, sf):
    p = ev.multiplicity(fx.with_sample(fx.particles(spark, sf)), ("sample", "event_id"))
    return ev.match_counts(p)


def multiplicity(spark, sf):
    return ev.multiplicity(fx.particles(spark, sf))


def multiplicity_stats(spark, sf):
    return rounded(ev.multiplicity_stats(fx.with_sample(fx.particles(spark, sf))), ["mean", "std"])


def leading_particle(spark, sf):
    return rounded(ev.leading_particle(fx.particles(spark, sf)), ["e", "px", "py", "pz"])


def extract_column(spark, sf):
    p = fx.particles(spark, sf)
    every = ev.extract_column(p, "pt").select("event_id", F.lit("all_pt").alias("what"), "value")
    lead = ev.extract_column(p, "eta", leading=True).select("event_id", F.lit("leading_eta").alias("what"), "value")
    count = ev.extract_column(p, "num_particles").select(
        "event_id", F.lit("num_particles").alias("what"), F.col("value").cast("double").alias("value"))
    return rounded(every.unionByName(lead).unionByName(count), ["value"])


def energy_balance(spark, sf):
    return rounded(ev.energy_balance(fx.particles(spark, sf)), ["e_in", "e_out", "energy_balance"], 4)


def ein_eout(spark, sf):
    return rounded(ev.system_energies(fx.particles(spark, sf), fx.pdg(spark)), ["e_in", "e_out"], 4)


def join_mass(spark, sf):
    return ev.with_mass(fx.particles(spark, sf), fx.pdg(spark)).select(*ID, "pdgid", "mass")


def pdgid_freq(spark, sf):
    return ev.pdgid_frequency(fx.particles(spark, sf))


def pdgid_occurrences(spark, sf):
    return ev.pdgid_occurrences(fx.particles(spark, sf))


def rarest_n(spark, sf):
    return ev.rarest_ids(fx.particles(spark, sf), 4).select("pdgid", "n_events")


def events_lost(spark, sf):
    return ev.events_with_rarest(fx.particles(spark, sf), 3)


def join_events_with_rare(spark, sf):
    p = fx.particles(spark, sf)
    return ev.events_with_rarest(p, 2).withColumn("kept", F.lit(False)).unionByName(
        ev.events_without_rarest(p, 2).withColumn("kept", F.lit(True)))


def max_removable_ids(spark, sf):
    p = fx.particles(spark, sf)
    budget = p.select("event_id").distinct().count() // 2
    return ev.max_removable_ids(p, budget)


def profile_events(spark, sf):
    return ev.profile(ev.nest_events(fx.particles(spark, sf)))


def meta_event_counts(spark, sf):
    return ev.profile(ev.nest_events(ev.valid_events(fx.particles(spark, sf))))


QUERIES = {f.__name__: f for f in (
    kin_polar, kin_verbose, kin_features, kin_encode_vars, kin_from_pt_eta_phi, kin_from_e_theta_phi,
    kin_from_cartesian, jet_view, explode_events, nest_events, epoch_of_iter, valid_events,
    valid_nested_events, drop_incident, event_multiplicity_filter, first_n_events, match_counts,
    multiplicity, multiplicity_stats, leading_particle, extract_column, energy_balance, ein_eout,
    join_mass, pdgid_freq, pdgid_occurrences, rarest_n, events_lost, join_events_with_rare,
    max_removable_ids, profile_events, meta_event_counts)}

_P, _V, _OK = f"with {fx.PARTICLES_CTE} ", f"with {fx.VERBOSE_CTE} ", f"with {fx.VALID_CTE} "
_RARE = """, per_id as (select pdgid, count(distinct event_id) as n_events from particles group by pdgid),
ranked as (select *, row_number() over (order by n_events, pdgid) as rk from per_id)"""
_LEAD = """, lead as (select * from (select *, row_number() over (partition by event_id order by e desc, particle_idx) as rn
  from vb where particle_idx > 0) where rn = 1)"""

ORACLE = {
    "kin_polar": _V + f"select event_id, particle_idx, {rs(['pt', 'eta', 'theta', 'phi'])} from vb",
    "kin_verbose": _V + "select event_id, particle_idx, pdgid, "
                   f"{rs(['e', 'px', 'py', 'pz', 'pt', 'eta', 'theta', 'phi'])} from vb",
    "kin_features": _V + f"select event_id, particle_idx, pdgid, {rs(['pt', 'eta', 'phi'])} from vb",
    "kin_encode_vars": _V + """select event_id, particle_idx, round(pt, 6) + 0.0e0 as pt,
        round(asinh(pz / pt), 6) + 0.0e0 as eta, round(acos(pz / r), 6) + 0.0e0 as theta,
        round(phi, 6) + 0.0e0 as phi from vb""",
    "kin_from_pt_eta_phi": _P + f""", f as (select *, sqrt(px*px + py*py) as pt, asinh(pz / sqrt(px*px + py*py)) as eta,
        atan2(py, px) as phi from particles),
        v as (select event_id, particle_idx, pdgid, sqrt(mass*mass + pow(pt * cosh(eta), 2)) as e, pt * cos(phi) as px,
        pt * sin(phi) as py, pt * sinh(eta) as pz from f)
        select event_id, particle_idx, pdgid, {rs(VECTOR, 4)} from v""",
    "kin_from_e_theta_phi": _V + f""", v as (select event_id, particle_idx, pdgid, e,
        sqrt(e*e - mass*mass) * sin(theta) * cos(phi) as px, sqrt(e*e - mass*mass) * sin(theta) * sin(phi) as py,
        sqrt(e*e - mass*mass) * cos(theta) as pz from vb)
        select event_id, particle_idx, pdgid, {rs(VECTOR, 4)} from v""",
    "kin_from_cartesian": _P + f"select event_id, particle_idx, pdgid, {rs(VECTOR, 4)} from particles",
    "jet_view": _V + f"select event_id, particle_idx, {rs(['eta', 'phi', 'pt'])} from vb",
    "explode_events": _P + "select event_id, particle_idx, pdgid, round(e, 6) as e from particles",
    "nest_events": _P + """select event_id, string_agg(pdgid || ':' || cast(round(pz * 1000) as bigint), ';'
        order by particle_idx) as particles from particles group by event_id""",
    "epoch_of_iter": f"with {fx.LOG_CTE} select model, iter, iter // 64 as epoch, iter % 64 as iter_in_epoch, "
                     "round(iter / 64.0e0, 6) as epoch_fraction from tlog",
    "valid_events": _OK + "select event_id, particle_idx, pdgid from valid",
    "valid_nested_events": _OK + "select event_id, count(*) as n_particles from valid group by event_id",
    "drop_incident": _P + "select event_id, particle_idx, pdgid, round(e, 6) as e from particles where particle_idx > 0",
    "event_multiplicity_filter": _P + """select 'cut' as mode, event_id, count(*) as n_particles, round(sum(pz), 3) + 0.0e0 as pz_sum
        from particles where particle_idx < 6 group by event_id having count(*) >= 3
        union all select 'drop', event_id, count(*), round(sum(pz), 3) + 0.0e0 from particles group by event_id having count(*) between 3 and 6""",
    "first_n_events": _P + "select event_id, particle_idx, pdgid, round(e, 6) as e from particles where event_id < 5000",
    "match_counts": _P + """, m as (select sample, event_id, count(*) - 1 as num_particles from particles group by all),
        n as (select min(c) as c from (select count(*) as c from m group by sample))
        select sample, event_id, num_particles from m
        qualify row_number() over (partition by sample order by event_id) <= (select c from n)""",
    "multiplicity": _P + "select event_id, count(*) - 1 as num_particles from particles group by event_id",
    "multiplicity_stats": _P + """, m as (select sample, event_id, count(*) - 1 as k from particles group by all)
        select sample, count(*) as n_events, round(avg(k), 6) as mean, round(stddev_pop(k), 6) as std from m group by sample""",
    "leading_particle": _V + _LEAD + f" select event_id, particle_idx, pdgid, {rs(['e', 'px', 'py', 'pz'])} from lead",
    "extract_column": _V + _LEAD + """ select event_id, 'all_pt' as what, round(pt, 6) as value from vb where particle_idx > 0
        union all select event_id, 'leading_eta', round(eta, 6) + 0.0e0 from lead
        union all select event_id, 'num_particles', cast(count(*) - 1 as double) from vb group by event_id""",
    "energy_balance": _P + """, s as (select event_id, sum(case when particle_idx = 0 then e end) as e_in,
        coalesce(sum(case when particle_idx > 0 then e end), 0.0e0) as e_out from particles group by event_id)
        select event_id, round(e_in, 4) as e_in, round(e_out, 4) as e_out, round(abs(e_in - e_out), 4) as energy_balance from s""",
    "ein_eout": _P + """, s as (select event_id, sum(case when particle_idx = 0 then e end) + 11178.0e0 as e_in,
        coalesce(sum(case when particle_idx > 0 then e end), 0.0e0) as e_out from particles group by event_id)
        select event_id, round(e_in, 4) as e_in, round(e_out, 4) as e_out from s""",
    "join_mass": _P + "select event_id, particle_idx, pdgid, mass from particles",
    "pdgid_freq": _P + "select pdgid, count(*) as n_particles, count(distinct event_id) as n_events from particles group by pdgid",
    "pdgid_occurrences": _P + "select pdgid, event_id, count(*) as n from particles group by all",
    "rarest_n": _P + _RARE + " select pdgid, n_events from ranked where rk <= 4",
    "events_lost": _P + _RARE + """ select distinct event_id from particles
        where pdgid in (select pdgid from ranked where rk <= 3)""",
    "join_events_with_rare": _P + _RARE + """ select event_id,
        not bool_or(pdgid in (select pdgid from ranked where rk <= 2)) as kept from particles group by event_id""",
    "max_removable_ids": _P + _RARE + """, budget as (select count(distinct event_id) // 2 as b from particles),
        lost as (select k.rk - 1 as i, (select count(distinct p.event_id) from particles p join ranked q on p.pdgid = q.pdgid
          where q.rk < k.rk) as n from ranked k)
        select cast(max(i) as bigint) as n_removable from lost where n <= (select b from budget)""",
    "profile_events": _P + """select count(*) as num_events, max(c) as num_particles_max
        from (select count(*) as c from particles group by event_id)""",
    "meta_event_counts": _OK + """select count(*) as num_events, max(c) as num_particles_max
        from (select count(*) as c from valid group by event_id)""",
}
