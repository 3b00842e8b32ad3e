"""Queries on distribution distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.operators import distances as ds
from eventspark.operators import events as ev
from eventspark.operators import histograms as hs
from eventspark.plans import fixtures as fx
from eventspark.plans.particles import r, rounded
from eventspark.schema import METRIC_FIELDS, small_table
from eventspark.scratch import store

BATCHES, COVER = 10, 100


def _jets(spark, sf):
    """(sample, event_id, eta, phi, pt) of the events an encoder accepts."""
    p = fx.with_sample(ev.with_encoder_variables(ev.valid_events(fx.particles(spark, sf), bounded=True)))
    return p.select("sample", "event_id", "particle_idx", "eta", "phi", "pt")


def _features(spark, sf):
    return ds.event_features(_jets(spark, sf), ("sample", "event_id"))


def _vectors(spark, sf):
    """Feature vectors, written once: the distances go over them several times."""
    return store(ds.as_vectors(_features(spark, sf)), "vectors")


def _long(spark, sf):
    return hs.stacked(_jets(spark, sf), ["eta", "phi", "pt"], ["sample", "event_id"])


def w1_feature(spark, sf):
    return rounded(ds.wasserstein(_long(spark, sf), ["feature"]), ["w1"])


def w1_multiplicity(spark, sf):
    m = ev.multiplicity(fx.with_sample(fx.particles(spark, sf)), ("sample", "event_id")).select(
        "sample", F.lit("num_particles").alias("feature"), F.col("num_particles").cast("double").alias("value"))
    return rounded(ds.wasserstein(m, ["feature"]), ["w1"])


def jet_mass(spark, sf):
    return rounded(ds.jet_mass(_jets(spark, sf)), ["mass"], 1)


def w1_mass(spark, sf):
    mass = ds.jet_mass(_jets(spark, sf), ("sample", "event_id")).select(
        "sample", F.lit("mass").alias("feature"), F.col("mass").alias("value"))
    return rounded(ds.wasserstein(mass, ["feature"]), ["w1"], 2)


def w1_batched(spark, sf):
    out = ds.wasserstein_batched(_long(spark, sf), ["feature"], "event_id", 5)
    return rounded(out, ["w1_mean", "w1_std"])


def event_features(spark, sf):
    # the polynomials span many orders of magnitude: compared on a logarithmic scale
    out = _features(spark, sf).withColumns({
        n: r(F.log(1.0 + F.col(n)), 5) for n in ("efp_edge", "efp_double", "efp_wedge")})
    return rounded(rounded(out, ["sum_pt"], 4), ["multiplicity", "mass"], 1)


def join_in_event_pairs(spark, sf):
    out = ds.event_pair_sums(_jets(spark, sf))
    return rounded(out.withColumn("pair_dot", r(F.log(1.0 + F.col("pair_dot")), 5)), ["pair_deta2"], 4)


def join_sample_pairs(spark, sf):
    x = fx.embeddings(spark, sf).withColumn("batch", F.col("vec_id") % 8 - F.col("vec_id") % 2)
    return rounded(ds.sample_pair_sums(x, ["batch"]), ["sum_dot", "sum_sq"], 3)


def feature_mean_cov(spark, sf):
    return rounded(ds.feature_mean_cov(fx.embeddings(spark, sf)), ["mean_i", "mean_j", "cov"], 8)


def fpd(spark, sf):
    value, error = ds.fpd(_vectors(spark, sf))
    return rounded(small_table(spark, [(value, error)], "fpd_value double, fpd_error double"), ["fpd_value", "fpd_error"], 9)


def kpd(spark, sf):
    return rounded(ds.kpd(_vectors(spark, sf), BATCHES), ["kpd_median", "kpd_error"], 7)


def coverage_mmd(spark, sf):
    return rounded(ds.coverage_batches(_vectors(spark, sf), COVER), ["coverage", "mmd"])


def w1_efp(spark, sf):
    names = ["efp_edge", "efp_double", "efp_wedge"]
    long = hs.stacked(_features(spark, sf), names, ["sample", "event_id"])
    return rounded(ds.wasserstein(long, ["feature"]), ["w1"], 4)


def metrics_row(spark, sf):
    return rounded(ds.metrics_row(_jets(spark, sf), BATCHES, COVER), METRIC_FIELDS, 5)


QUERIES = {f.__name__: f for f in (
    w1_feature, w1_multiplicity, jet_mass, w1_mass, w1_batched, event_features, join_in_event_pairs,
    join_sample_pairs, feature_mean_cov, fpd, kpd, coverage_mmd, w1_efp, metrics_row)}

_P, _OK = f"with {fx.PARTICLES_CTE}", f"with {fx.VALID_CTE}"
_LONG = """, vals as (select sample, event_id, 'eta' as feature, eta as v from valid union all
  select sample, event_id, 'phi', phi from valid union all select sample, event_id, 'pt', pt from valid)"""
_PAIRS = """, pr as (select a.event_id, a.particle_idx as i, b.particle_idx as j, a.sample, a.pt as pa, b.pt as pb,
    2 * (cosh(a.eta - b.eta) - cos(a.phi - b.phi)) as th, a.eta - b.eta as de from valid a join valid b on a.event_id = b.event_id),
  st as (select event_id, any_value(sample) as sample, sum(pt) as s, count(*) as n from valid group by event_id),
  node as (select p.event_id, p.j, any_value(p.pb) as pb, sum(p.pa * p.th) as w, sum(p.pa * p.pb * p.th) as e1,
    sum(p.pa * p.pb * p.th * p.th) as e2 from pr p group by p.event_id, p.j),
  feats as (select st.event_id, st.sample, cast(st.n as double) as multiplicity, st.s as sum_pt, sqrt(greatest(sum(e1) / 2, 0.0e0)) as mass,
    sum(e1) / (st.s * st.s) as efp_edge, sum(e2) / (st.s * st.s) as efp_double, sum(pb * w * w) / (st.s * st.s * st.s) as efp_wedge
    from node join st on node.event_id = st.event_id group by st.event_id, st.sample, st.n, st.s)"""
_NAMES = ("multiplicity", "sum_pt", "mass", "efp_edge", "efp_double", "efp_wedge")
_SCALED = _PAIRS + """, top as (select """ + ", ".join(f"max(abs({n})) as {n}" for n in _NAMES) + """ from feats where sample = 'ref'),
  vec as (select f.event_id, f.sample, """ + ", ".join(f"f.{n} / t.{n} as x{i}" for i, n in enumerate(_NAMES)) + " from feats f, top t)"


def _hash(n, ident="event_id", seed=0):
    return f"cast('0x' || substr(md5('{seed}:' || {ident}), 1, 8) as bigint) % {n}"


def _w1(by, source="vals"):
    """Distance from all distinct points: distribution functions by counting."""
    return f""", pts as (select {by}, v, count(*) filter (where sample = 'ref') as a, count(*) filter (where sample = 'gen') as b from {source} group by all),
      cum as (select {by}, v, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by {by}) as na, sum(b) over (partition by {by}) as nb,
        lead(v) over w as nv from pts window w as (partition by {by} order by v)),
      dist as (select {by}, sum(abs(ca / na - cb / nb) * (nv - v)) as w1 from cum group by {by})"""


_KERNEL = "pow((" + " + ".join(f"a.x{i} * b.x{i}" for i in range(6)) + ") / 6 + 1, 4)"
_DIST = "sqrt(" + " + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(6)) + ")"


def _product(a: str, b: str, d: int = 6) -> str:
    """The product of two matrices kept as lists, row by row."""
    return "[" + ", ".join(" + ".join(f"{a}[{i * d + k + 1}] * {b}[{k * d + j + 1}]" for k in range(d)) for i in range(d) for j in range(d)) + "]"


_TRACE = "+".join(f"{{0}}[{i * 7 + 1}]" for i in range(6))
_THREE_LESS = "[" + ", ".join(f"{3 if i == j else 0}.0e0 - q[{i * 6 + j + 1}]" for i in range(6) for j in range(6)) + "]"
_UNIT = "[" + ", ".join("1e0" if i == j else "0e0" for i in range(6) for j in range(6)) + "]"
# kernel distance of each batch
_KPD = f""", kb as (select *, {_hash(BATCHES)} as batch from vec),
  ks as (select a.batch, a.sample as sa, b.sample as sb, avg({_KERNEL}) as k from kb a join kb b on a.batch = b.batch and a.event_id <> b.event_id group by all),
  mm as (select batch, sum(case when sa = sb then k else -k end) as m from ks group by batch),
  kpd as (select median(m) as kpd_median, (quantile_cont(m, 0.83725e0) - quantile_cont(m, 0.16275e0)) / 2 as kpd_error from mm)"""
# nearest events of each batch
_COVERAGE = f""", c as (select cast(ceil(min(n) / {COVER}.0e0) as bigint) as k from (select count(*) as n from vec group by sample)),
  bt as (select *, {_hash("(select k from c)")} as batch from vec),
  refs as (select batch, count(*) as n from bt where sample = 'ref' group by batch),
  cp as (select a.batch, a.event_id as i, b.event_id as j, {_DIST} as d from bt a join bt b on a.batch = b.batch and a.sample = 'ref' and b.sample = 'gen'),
  near as (select batch, avg(d) as mmd from (select batch, i, min(d) as d from cp group by batch, i) group by batch),
  hit as (select batch, i, row_number() over (partition by batch, j order by d, i) as rk from cp),
  cov as (select batch, count(distinct i) as k from hit where rk = 1 group by batch),
  covered as (select r.batch, r.n, coalesce(cov.k, 0) / r.n as coverage, near.mmd
    from refs r left join near on r.batch = near.batch left join cov on r.batch = cov.batch)"""
# distance of Gaussians from growing shares of the events; the root of the product of covariances by a coupled
# Newton iteration, the value for infinitely many events by a straight line in 1/n
_FPD = f""", sh as (select sample, {_hash(10)} as s, [x0, x1, x2, x3, x4, x5] as x from vec),
  grown as (select k, sample, x from sh, (select unnest(range(10)) as k) where s <= k),
  cells as (select k, sample, x, unnest(range(36)) as t from grown),
  cvs as (select k, sample, t, covar_samp(x[t // 6 + 1], x[t % 6 + 1]) as c, avg(x[t // 6 + 1]) as m, count(*) as n from cells group by all),
  mats as (select k, sample, list(c order by t) as c, list(m order by t) filter (where t % 6 = 0) as m, max(n) as n from cvs group by k, sample having max(n) > 6),
  both_sides as (select a.k, least(a.n, b.n) as n, a.c as ca, b.c as cb, list_distance(a.m, b.m) as far from mats a join mats b on a.k = b.k and a.sample = 'ref' and b.sample = 'gen'),
  multiplied as (select *, {_product("ca", "cb")} as p from both_sides),
  newton as (
    select k, 0 as step, list_transform(p, lambda v: v / ({_TRACE.format("p")})) as y, {_UNIT} as z from multiplied
    union all select k, step + 1, {_product("y", "w")}, {_product("w", "z")}
    from (select k, step, y, z, list_transform({_THREE_LESS}, lambda v: v / 2) as w from (select *, {_product("z", "y")} as q from newton where step < 60))),
  rooted as (select k, {_TRACE.format("y")} as root from newton where step = 60),
  points as (select 1e0 / n as x, far * far + ({_TRACE.format("ca")}) + ({_TRACE.format("cb")}) - 2 * sqrt({_TRACE.format("p")}) * root as y
    from multiplied m join rooted r on m.k = r.k),
  line as (select regr_intercept(y, x) as a, regr_slope(y, x) as b, count(*) as k, sum(x) as sx, sum(x * x) as sxx from points),
  fpd as (select any_value(a) as fpd_value,
    sqrt(sum(pow(y - a - b * x, 2)) / (any_value(k) - 2) * any_value(sxx) / (any_value(k) * any_value(sxx) - pow(any_value(sx), 2))) as fpd_error from points, line)"""

ORACLE = {
    "w1_feature": _OK + _LONG + _w1("feature") + " select feature, round(w1, 6) as w1 from dist",
    "w1_multiplicity": _P + ", vals as (select sample, 'num_particles' as feature, cast(count(*) - 1 as double) as v from particles group by sample, event_id)"
        + _w1("feature") + " select feature, round(w1, 6) as w1 from dist",
    "jet_mass": _OK + _PAIRS + " select event_id, round(mass, 1) + 0.0e0 as mass from feats",
    "w1_mass": _OK + _PAIRS + ", vals as (select sample, 'mass' as feature, mass as v from feats)" + _w1("feature")
        + " select feature, round(w1, 2) as w1 from dist",
    "w1_batched": _OK + _LONG + f", bv as (select *, {_hash(5)} as batch from vals)" + _w1("feature, batch", "bv")
        + " select feature, round(avg(w1), 6) as w1_mean, round(stddev_pop(w1), 6) as w1_std from dist group by feature",
    "event_features": _OK + _PAIRS + """ select sample, event_id, round(multiplicity, 1) as multiplicity, round(sum_pt, 4) as sum_pt, round(mass, 1) + 0.0e0 as mass,
        round(ln(1 + efp_edge), 5) + 0.0e0 as efp_edge, round(ln(1 + efp_double), 5) + 0.0e0 as efp_double,
        round(ln(1 + efp_wedge), 5) + 0.0e0 as efp_wedge from feats""",
    "join_in_event_pairs": _OK + _PAIRS + """ select event_id, count(*) filter (where i < j) as n_pairs,
        round(ln(1 + coalesce(sum(pa * pb * th / 2) filter (where i < j), 0.0e0)), 5) + 0.0e0 as pair_dot,
        round(coalesce(sum(de * de) filter (where i < j), 0.0e0), 4) + 0.0e0 as pair_deta2 from pr group by event_id""",
    "join_sample_pairs": """with em as (select vec_id, [cast(v as double) for v in embedding] as x, vec_id % 8 - vec_id % 2 as batch, vec_id % 2 as s from embeddings),
        pr as (select a.batch, a.x as x, b.x as y from em a join em b on a.batch = b.batch and a.s = 0 and b.s = 1)
        select batch, count(*) as n_pairs, round(sum(list_dot_product(x, y)), 3) + 0.0e0 as sum_dot,
          round(sum(pow(list_distance(x, y), 2)), 3) as sum_sq from pr group by batch""",
    "feature_mean_cov": """with em as (select case when vec_id % 2 = 0 then 'ref' else 'gen' end as sample, embedding as x from embeddings),
        pr as (select sample, unnest(range(64)) as i, x from em), pq as (select sample, i, unnest(range(i, 64)) as j, x from pr)
        select sample, i, j, round(avg(cast(x[i + 1] as double)), 8) + 0.0e0 as mean_i, round(avg(cast(x[j + 1] as double)), 8) + 0.0e0 as mean_j,
          round(covar_samp(cast(x[i + 1] as double), cast(x[j + 1] as double)), 8) + 0.0e0 as cov from pq group by sample, i, j""",
    "kpd": _OK + _SCALED + _KPD + " select round(kpd_median, 7) + 0.0e0 as kpd_median, round(kpd_error, 7) + 0.0e0 as kpd_error from kpd",
    "coverage_mmd": _OK + _SCALED + _COVERAGE + " select batch, n, round(coverage, 6) as coverage, round(mmd, 6) as mmd from covered",
    "fpd": _OK.replace("with ", "with recursive ", 1) + _SCALED + _FPD + " select round(fpd_value, 9) + 0.0e0 as fpd_value, round(fpd_error, 9) + 0.0e0 as fpd_error from fpd",
    "metrics_row": _OK.replace("with ", "with recursive ", 1) + _SCALED + _KPD + _COVERAGE + _FPD + """, vals as (
          select sample, event_id, 'eta' as feature, eta as v from valid union all select sample, event_id, 'phi', phi from valid
          union all select sample, event_id, 'pt', pt from valid union all select sample, event_id, 'mass', mass from feats),"""
        + f" bv as (select *, {_hash(BATCHES)} as wb from vals)" + _w1("feature, wb", "bv") + """,
        w as (select feature, avg(w1) as m, stddev_pop(w1) as s from dist group by feature),
        cvd as (select sum(coverage * n) / sum(n) as coverage, sum(mmd * n) / sum(n) filter (where mmd is not null) as mmd from covered)
        select """ + ", ".join(f"round({c}, 5) + 0.0e0 as {n}" for n, c in (
            ("coverage", "(select coverage from cvd)"), ("mmd", "(select mmd from cvd)"), ("kpd_median", "(select kpd_median from kpd)"),
            ("kpd_error", "(select kpd_error from kpd)"), ("fpd_value", "(select fpd_value from fpd)"), ("fpd_error", "(select fpd_error from fpd)"),
            *((f"{key}{end}", f"(select {col} from w where feature = '{name}')") for key, name in (("w1m_score", "mass"), ("w1p_avg_eta", "eta"),
              ("w1p_avg_phi", "phi"), ("w1p_avg_pt", "pt")) for end, col in (("", "m"), ("_std", "s"))))),
    "w1_efp": _OK + _PAIRS + """, vals as (select sample, 'efp_edge' as feature, efp_edge as v from feats union all
        select sample, 'efp_double', efp_double from feats union all select sample, 'efp_wedge', efp_wedge from feats)"""
        + _w1("feature") + " select feature, round(w1, 4) as w1 from dist",
}
