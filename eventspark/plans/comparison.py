"""Queries that compare a generated with a reference sample: histograms, categories, ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.functions.binning import bucketize, gaussian_bins, linear_bins, step_bins
from eventspark.operators import comparison as cp
from eventspark.operators import events as ev
from eventspark.operators import histograms as hs
from eventspark.operators.quantiles import quantile_bins
from eventspark.plans import fixtures as fx
from eventspark.plans.particles import ID, r, rounded

LEAD_PT = linear_bins("pt", 0.0, 1120.0, 28)
PZ = linear_bins("pz", *hs.DEFAULT_RANGES["pz"])
COARSE_PZ = step_bins("pz", -9000.0, 9000.0, 1437.0)
GAUSS_PZ = gaussian_bins("pz", -10000.0, 11000.0, 40, 0.0, 3000.0)
MANY = {"e": linear_bins("e", *hs.DEFAULT_RANGES["e"]), "px": linear_bins("px", *hs.DEFAULT_RANGES["px"]),
        "py": linear_bins("py", *hs.DEFAULT_RANGES["py"]), "pz": PZ,
        "pt": linear_bins("pt", 0.0, 1197.0, 70), "eta": linear_bins("eta", -4.0, 4.01, 80),
        "theta": linear_bins("theta", 0.0, 3.15, 31), "phi": linear_bins("phi", -3.15, 3.15, 62)}


def _particles(spark, sf):
    return fx.with_sample(fx.particles(spark, sf))


def _leading_pt(spark, sf):
    lead = ev.leading_particle(_particles(spark, sf), ("px", "py", "pz", "e"), ("sample", "event_id"))
    return ev.with_polar(lead).select("sample", F.col("pt").alias("value"))


def hist_counts(spark, sf):
    return hs.histogram(_leading_pt(spark, sf), LEAD_PT, fx.SAMPLES).select(
        F.col("bin").cast("long").alias("bin"), "sample", "n")


def hist_density(spark, sf):
    values = ev.secondaries(_particles(spark, sf)).select("sample", F.col("pz").alias("value"))
    counts = hs.histogram(values, PZ, fx.SAMPLES)
    shares = hs.density(counts, F.col("hi") - F.col("lo"))
    return shares.select(F.col("bin").cast("long").alias("bin"), "sample", "n", r(F.col("density"), 10).alias("density"),
                         r(F.col("density_err"), 10).alias("density_err"), r(F.col("count_err")).alias("count_err"))


def hist_ratio(spark, sf):
    counts = hs.histogram(_leading_pt(spark, sf), LEAD_PT, fx.SAMPLES)
    out = hs.ratio(counts, ("bin", "lo", "hi"), "ref", limits=(0.5, 1.5))
    return out.select(F.col("bin").cast("long").alias("bin"), r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"),
                      "n_ref", "n_gen", r(F.col("ratio")).alias("ratio"), r(F.col("ratio_err")).alias("ratio_err"),
                      "above", "below")


def hist_all_features(spark, sf):
    particles, vector = _particles(spark, sf), ("e", "px", "py", "pz")
    every = ev.secondaries(particles).select("sample", F.lit("all").alias("selection"), *vector)
    lead = ev.leading_particle(particles, vector, ("sample", "event_id")).select("sample", F.lit("leading").alias("selection"), *vector)
    both = ev.with_polar(every.unionByName(lead))  # of a leading particle after it is known
    return hs.histogram_many(both, MANY, ["sample", "selection"]).withColumn("bin", F.col("bin").cast("long"))


WHOLE = MANY | {"num_particles": linear_bins("num_particles", *hs.DEFAULT_RANGES["num_particles"]),
                "energy_conservation": linear_bins("energy_conservation", *hs.DEFAULT_RANGES["energy_conservation"])}


def compare_samples(spark, sf):
    """Every histogram, density, error and ratio of the comparison, empty bins included."""
    out = cp.compare_samples(_particles(spark, sf), WHOLE, fx.SAMPLES)
    out = rounded(out, ["lo", "hi", "ratio", "ratio_err"], 6)
    return rounded(out, ["density_ref", "density_gen", "density_err_ref", "density_err_gen"], 10)


def category_density(spark, sf):
    out = hs.category_density(ev.secondaries(_particles(spark, sf)), "pdgid", fx.SAMPLES)
    return out.select("pdgid", "sample", "n", r(F.col("density"), 8).alias("density"),
                      r(F.col("density_err"), 8).alias("density_err"))


def category_ratio(spark, sf):
    counts = hs.category_counts(ev.secondaries(_particles(spark, sf)), "pdgid", fx.SAMPLES)
    out = hs.ratio(hs.long_counts(counts, "pdgid", fx.SAMPLES), ("pdgid",), "ref")
    return out.select("pdgid", "n_ref", "n_gen", r(F.col("ratio")).alias("ratio"), r(F.col("ratio_err")).alias("ratio_err"))


def join_category_freq(spark, sf):
    return hs.category_counts(ev.secondaries(_particles(spark, sf)), "pdgid", fx.SAMPLES)


def category_topk(spark, sf):
    counts = hs.category_counts(ev.secondaries(_particles(spark, sf)), "pdgid", fx.SAMPLES)
    return hs.category_top(counts, "pdgid", "ref", 5)


def category_union(spark, sf):
    m = ev.multiplicity(_particles(spark, sf), ("sample", "event_id"))
    return hs.category_union(m.filter("sample = 'ref'"), m.filter("sample = 'gen'"), "num_particles")


def join_bin_counts(spark, sf):
    m = ev.multiplicity(_particles(spark, sf), ("sample", "event_id")).withColumn(
        "value", F.col("num_particles").cast("double"))
    bins = linear_bins("num_particles", *hs.DEFAULT_RANGES["num_particles"])
    return hs.histogram(m, bins, fx.SAMPLES).select(F.col("bin").cast("long").alias("bin"), "lo", "hi", "sample", "n")


def _bucketed(spark, sf, column, bins):
    p = ev.with_polar(fx.particles(spark, sf))
    return bucketize(p, column, bins, "bin").select(*ID, F.col("bin").cast("long").alias("bin"))


def bucket_linear(spark, sf):
    return _bucketed(spark, sf, "eta", fx.ETA_BINS)


def bucket_step(spark, sf):
    return _bucketed(spark, sf, "pz", COARSE_PZ)


def bucket_gaussian(spark, sf):
    return _bucketed(spark, sf, "pz", GAUSS_PZ)


def bucket_quantile(spark, sf):
    p = fx.particles(spark, sf)
    bins = quantile_bins(p, "e", 20)
    return bucketize(p, "e", bins, "bin").select(*ID, F.col("bin").cast("long").alias("bin"))


def bucketize_query(spark, sf):
    out = fx.particles(spark, sf)
    for column, bins in (("px", MANY["px"]), ("py", MANY["py"]), ("pz", GAUSS_PZ)):
        out = bucketize(out, column, bins, f"{column}_bin")
    return out.groupBy("px_bin", "py_bin", "pz_bin").agg(F.count(F.lit(1)).alias("n")).select(
        *[F.col(c).cast("long").alias(c) for c in ("px_bin", "py_bin", "pz_bin")], "n")


def join_value_bin(spark, sf):
    out = hs.values_with_bin(fx.particles(spark, sf), "pz", COARSE_PZ)
    return out.select(*ID, F.col("bin").cast("long").alias("bin"), r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"))


def bin_means(spark, sf):
    out = hs.bin_means(fx.particles(spark, sf), "px", linear_bins("px", -1200.0, 1200.0, 30))
    return out.select(F.col("bin").cast("long").alias("bin"), "n", r(F.col("mean"), 4).alias("mean"))


QUERIES = {f.__name__: f for f in (
    compare_samples,
    hist_counts, hist_density, hist_ratio, hist_all_features, category_density, category_ratio,
    join_category_freq, category_topk, category_union, join_bin_counts, bucket_linear, bucket_step,
    bucket_gaussian, bucket_quantile, join_value_bin, bin_means)} | {"bucketize": bucketize_query}

_P, _V = f"with {fx.PARTICLES_CTE}", f"with {fx.VERBOSE_CTE}"
_LEAD = """, lead as (select * from (select *, row_number() over (partition by event_id order by e desc, particle_idx) as rn
  from vb where particle_idx > 0) where rn = 1)"""


def _edges(name, bins):
    rows = ", ".join(f"(cast({i} as bigint), {fx.number(a)}, {fx.number(b)})"
                     for i, (a, b) in enumerate(zip(bins.edges, bins.edges[1:])))
    return f", {name}(bin, lo, hi) as (values {rows})"


_S = ", s(sample) as (values ('ref'), ('gen'))"


def _hist(source, value, bins):
    """Counts by a real range join; the last bin is closed."""
    last = fx.number(bins.edges[-1])
    return (_edges("b", bins) + _S + f""", h as (select b.bin, s.sample, b.lo, b.hi, count(d.v) as n from b cross join s
        left join (select sample, {value} as v from {source}) d on d.sample = s.sample
          and d.v >= b.lo and (d.v < b.hi or (d.v = {last} and b.hi = {last}))
        group by b.bin, s.sample, b.lo, b.hi)""")


_RATIO = """, t as (select sample, sum(n) as total from h group by sample),
  g as (select {key}, n, n / (select total from t where sample = 'gen') as d from h where sample = 'gen'),
  f as (select {key}, n, n / (select total from t where sample = 'ref') as d from h where sample = 'ref')
  select {cols}, cast(f.n as bigint) as n_ref, cast(g.n as bigint) as n_gen,
    round(case when f.n > 0 then g.d / f.d end, 6) + 0.0e0 as ratio,
    round(case when f.n > 0 and g.n > 0 then g.d / f.d * sqrt(1.0e0 / g.n + 1.0e0 / f.n) end, 6) + 0.0e0 as ratio_err{extra}
  from f join g using ({key})"""
_CAT = """, h as (select pdgid, sample, count(d.event_id) as n from (select distinct pdgid from particles where particle_idx > 0) c
  cross join s left join (select pdgid as id, sample as smp, event_id from particles where particle_idx > 0) d
  on d.id = c.pdgid and d.smp = s.sample group by pdgid, sample)"""
_FREQ = """select pdgid, count(*) filter (where sample = 'ref') as ref, count(*) filter (where sample = 'gen') as gen
  from particles where particle_idx > 0 group by pdgid"""
_MANY = " union all ".join(
    f"select sample, '{sel}' as selection, '{f}' as feature, {fx.bin_sql(f, b)} as bin, count(*) as n from {src} "
    f"where {f} >= {fx.number(b.edges[0])} and {f} <= {fx.number(b.edges[-1])} group by all"
    for sel, src in (("all", "vb where particle_idx > 0 and true"), ("leading", "lead")) for f, b in MANY.items()
).replace("and true where", "and")


_GRID = ", grid(selection, feature, bin, lo, hi) as (values " + ", ".join(
    f"('{sel}', '{f}', {i}, {fx.number(lo)}, {fx.number(hi)})" for f, b in WHOLE.items() for sel in (("event",) if f in cp.EVENT_FEATURES else ("all", "leading"))
    for i, (lo, hi) in enumerate(zip(b.edges, b.edges[1:]))) + ")"
_BY_EVENT = """, per_event as (select sample, event_id, cast(count(*) - 1 as double) as num_particles,
  abs(max(e) filter (where particle_idx = 0) - coalesce(sum(e) filter (where particle_idx > 0), 0.0e0)) as energy_conservation from particles group by all)"""
_EVENT_HISTS = " union all ".join(
    f"select sample, 'event' as selection, '{f}' as feature, {fx.bin_sql(f, WHOLE[f])} as bin, count(*) as n from per_event "
    f"where {f} >= {fx.number(WHOLE[f].edges[0])} and {f} <= {fx.number(WHOLE[f].edges[-1])} group by all" for f in cp.EVENT_FEATURES)
_COMPARED = f"""{_GRID}{_BY_EVENT}, found as ({_MANY} union all {_EVENT_HISTS}
    union all select sample, 'all', 'pdgid', pdgid, count(*) from vb where particle_idx > 0 group by sample, pdgid
    union all select sample, 'leading', 'pdgid', pdgid, count(*) from lead group by sample, pdgid),
  cells as (select * from grid union all select distinct selection, feature, bin, cast(null as double), cast(null as double) from found where feature = 'pdgid'),
  both_sides as (select c.*, coalesce(r.n, 0) as n_ref, coalesce(g.n, 0) as n_gen from cells c
    left join found r on r.selection = c.selection and r.feature = c.feature and r.bin = c.bin and r.sample = 'ref'
    left join found g on g.selection = c.selection and g.feature = c.feature and g.bin = c.bin and g.sample = 'gen'),
  scaled as (select *, sum(n_ref) over w * coalesce(hi - lo, 1.0e0) as s_ref, sum(n_gen) over w * coalesce(hi - lo, 1.0e0) as s_gen
    from both_sides window w as (partition by selection, feature)),
  dense as (select *, n_ref / s_ref as d_ref, n_gen / s_gen as d_gen from scaled)
  select selection, feature, cast(bin as bigint) as bin, round(lo, 6) + 0.0e0 as lo, round(hi, 6) + 0.0e0 as hi, cast(n_ref as bigint) as n_ref, cast(n_gen as bigint) as n_gen,
    round(d_ref, 10) as density_ref, round(d_gen, 10) as density_gen, round(sqrt(n_ref) / s_ref, 10) as density_err_ref, round(sqrt(n_gen) / s_gen, 10) as density_err_gen,
    round(case when n_ref > 0 then d_gen / d_ref end, 6) as ratio,
    round(case when n_ref > 0 and n_gen > 0 then d_gen / d_ref * sqrt(1.0e0 / n_gen + 1.0e0 / n_ref) end, 6) as ratio_err from dense"""


def _row_bins(expr, bins):
    return f" select event_id, particle_idx, {fx.bin_sql(expr, bins)} as bin from vb"


ORACLE = {
    "hist_counts": _V + _LEAD + _hist("lead", "pt", LEAD_PT) + " select bin, sample, n from h",
    "hist_density": _V + ", sec as (select * from vb where particle_idx > 0)" + _hist("sec", "pz", PZ) + """
        , t as (select sample, sum(n) as total from h group by sample)
        select h.bin, h.sample, h.n, round(h.n / (t.total * (h.hi - h.lo)), 10) as density,
          round(sqrt(h.n) / (t.total * (h.hi - h.lo)), 10) as density_err, round(sqrt(h.n), 6) as count_err
        from h join t on h.sample = t.sample""",
    "hist_ratio": _V + _LEAD + _hist("lead", "pt", LEAD_PT) + _RATIO.format(
        key="bin, lo, hi", cols="bin, round(lo, 6) + 0.0e0 as lo, round(hi, 6) + 0.0e0 as hi",
        extra=""", coalesce(case when f.n > 0 then g.d / f.d end > 1.49e0, false) as above,
          coalesce(case when f.n > 0 then g.d / f.d end < 0.51e0, false) as below"""),
    "compare_samples": _V + _LEAD + _COMPARED,
    "hist_all_features": _V + _LEAD + " " + _MANY,
    "category_density": _P + _S + _CAT + """, t as (select sample, sum(n) as total from h group by sample)
        select h.pdgid, h.sample, h.n, round(h.n / t.total, 8) as density, round(sqrt(h.n) / t.total, 8) as density_err
        from h join t on h.sample = t.sample""",
    "category_ratio": _P + _S + _CAT + _RATIO.format(key="pdgid", cols="pdgid", extra=""),
    "join_category_freq": _P + " " + _FREQ,
    "category_topk": _P + " " + _FREQ + " order by ref desc, pdgid limit 5",
    "category_union": _P + " select distinct count(*) - 1 as num_particles from particles group by event_id",
    "join_bin_counts": _P + ", m as (select sample, event_id, count(*) - 1 as k from particles group by all)"
        + _hist("m", "k", linear_bins("k", -0.5, 50.5, 51)) + " select bin, lo, hi, sample, n from h",
    "bucket_linear": _V + _row_bins("eta", fx.ETA_BINS),
    "bucket_step": _V + _row_bins("pz", COARSE_PZ),
    "bucket_gaussian": _V + _row_bins("pz", GAUSS_PZ),
    "bucket_quantile": _P + """, q as (select quantile_cont(e, [i / 20.0e0 for i in range(1, 20)]) as t from particles)
        select event_id, particle_idx, cast(len(list_filter((select t from q), lambda x: x <= e)) as bigint) as bin from particles""",
    "bucketize": _P + f""" select {fx.bin_sql('px', MANY['px'])} as px_bin, {fx.bin_sql('py', MANY['py'])} as py_bin,
        {fx.bin_sql('pz', GAUSS_PZ)} as pz_bin, count(*) as n from particles group by all""",
    "join_value_bin": _P + _edges("b", COARSE_PZ) + """ select p.event_id, p.particle_idx, b.bin,
        round(b.lo, 6) + 0.0e0 as lo, round(b.hi, 6) + 0.0e0 as hi
        from particles p join b on p.pz >= b.lo and p.pz < b.hi""",
    "bin_means": _P + _edges("b", linear_bins("px", -1200.0, 1200.0, 30)) + """ select b.bin, count(p.px) as n,
        round(coalesce(avg(p.px), 0.5e0 * (b.lo + b.hi)), 4) + 0.0e0 as mean from b left join particles p
        on (p.px > b.lo or b.bin = 0) and (p.px <= b.hi or b.bin = 29) group by b.bin, b.lo, b.hi""",
}
