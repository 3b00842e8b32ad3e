"""Event-shaped views over the given tables, for Spark and (as SQL text) for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.binning import Bins, linear_bins, literal_array, step_bins
from eventspark.operators.ordering import with_position
from eventspark.operators.vocabulary import Vocabulary
from eventspark.schema import small_table

# Public particle masses in MeV, by slot.
PDG = (
    (2212, "proton", 938.27208816),
    (2112, "neutron", 939.56542052),
    (211, "pi+", 139.57039),
    (-211, "pi-", 139.57039),
    (111, "pi0", 134.9768),
    (22, "gamma", 0.0),
    (11, "e-", 0.51099895),
    (321, "K+", 493.677),
    (-321, "K-", 493.677),
    (130, "K0L", 497.611),
    (310, "K0S", 497.611),
    (3122, "Lambda", 1115.683),
)
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
SAMPLES = ("ref", "gen")
PART_BYTES = 8 << 20  # of lines as they are stored, some 500,000

ETA_BINS = linear_bins("eta", -4.0, 4.01, 50)
PHI_BINS = linear_bins("phi", -3.15, 3.15, 50)
PT_BINS = step_bins("pt", 0.0, 1200.0, 50.0)
VOCAB = Vocabulary(
    special={"padding": 0, "event_start": 1, "event_end": 2, "particle_start": 3, "particle_end": 4},
    pdgids=(*[p[0] for p in PDG], 0, 0, 0),
    schema=("pdgid", "pt", "eta", "phi"),
    bins={"eta": ETA_BINS, "phi": PHI_BINS, "pt": PT_BINS})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pdg(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(PDG), "pdgid bigint, name string, mass double")


def _parts(df: DataFrame, session: int) -> int | None:
    """Number of partitions that keeps a sorted part of ``df`` within a task, where the session's number does not."""
    wanted = -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES)
    return wanted if wanted > session else None


def particles(spark: SparkSession, sf: str, in_order: bool = False) -> DataFrame:
    """One particle for each line item, events by order key.

    The lines of an event meet in one part, and nothing later has to move them again. ``in_order``: parts are ranges
    of events one after the other, dealt before anything is computed, as the sampling for ranges would compute it too.
    """
    lines = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    parts = _parts(lines, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if in_order:
        lines = lines.repartitionByRange(parts, "l_orderkey") if parts else lines.repartitionByRange("l_orderkey")
    elif parts:
        lines = lines.repartition(parts, "l_orderkey")
    placed = with_position(lines, LINE_ORDER, ["l_orderkey"], "particle_idx", bounded=True)
    slot = (F.col("l_partkey") % len(PDG)).cast("int")
    momenta = placed.select(
        F.col("l_orderkey").alias("event_id"), "particle_idx",
        F.get(literal_array([p[0] for p in PDG], "bigint"), slot).alias("pdgid"),
        F.get(literal_array([p[2] for p in PDG], "double"), slot).alias("mass"),
        ((F.col("l_quantity") - 25.5) * 40.0).alias("px"),
        ((F.round(F.col("l_discount") * 100.0) - 5.0) * 100.0).alias("py"),
        ((F.col("l_extendedprice") - 50000.0) / 5.0).alias("pz"))
    px, py, pz, mass = (F.col(c) for c in ("px", "py", "pz", "mass"))
    energy = F.sqrt(px * px + py * py + pz * pz + mass * mass)
    return momenta.select("event_id", "particle_idx", "pdgid", energy.alias("e"), "px", "py", "pz")


def with_sample(df: DataFrame) -> DataFrame:
    """Reference and generated sample by parity of the event."""
    return df.withColumn("sample", F.when(F.col("event_id") % 2 == 0, "ref").otherwise("gen"))


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training log rows from the event stream: one series for each event type."""
    placed = with_position(table(spark, sf, "events").select("event_id", "ts", "event_type", "value"),
                           ["ts", "event_id"], ["event_type"], "k")
    return placed.select(F.col("event_type").alias("model"), (F.col("k") * 10).alias("iter"),
                         (F.col("value") * 0.9).alias("train_loss"), F.col("value").alias("val_loss"),
                         (100.0 + (F.col("event_id") % 7)).cast("double").alias("time"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"),
        F.when(F.col("vec_id") % 2 == 0, "ref").otherwise("gen").alias("sample"))


# --- the same views as SQL ---------------------------------------------------

def number(x: float) -> str:
    """A double literal; a bare decimal point would make a decimal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def array_sql(values) -> str:
    return "[" + ", ".join(number(v) for v in values) + "]"


def bin_sql(expr: str, bins: Bins) -> str:
    """Bin by counting the inner edges at or below the value."""
    return f"cast(len(list_filter({array_sql(bins.thresholds)}, lambda t: t <= {expr})) as bigint)"


_PDG_ROWS = ", ".join(f"({i}, cast({p[0]} as bigint), '{p[1]}', {number(p[2])})" for i, p in enumerate(PDG))
PDG_CTE = f"pdg(slot, pdgid, name, mass) as (values {_PDG_ROWS})"
PARTICLES_CTE = f"""{PDG_CTE}, numbered as (
  select l_orderkey as event_id,
    cast(row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER)}) - 1 as bigint) as particle_idx,
    l_partkey % 12 as slot, (l_quantity - 25.5e0) * 40.0e0 as px,
    (round(l_discount * 100.0e0) - 5.0e0) * 100.0e0 as py, (l_extendedprice - 50000.0e0) / 5.0e0 as pz
  from lineitem),
particles as (
  select n.event_id, n.particle_idx, g.pdgid,
    sqrt(n.px*n.px + n.py*n.py + n.pz*n.pz + g.mass*g.mass) as e, n.px, n.py, n.pz, g.mass,
    case when n.event_id % 2 = 0 then 'ref' else 'gen' end as sample
  from numbered n join pdg g on n.slot = g.slot)"""
VERBOSE_CTE = PARTICLES_CTE + """,
radial as (select *, sqrt(px*px + py*py) as pt, sqrt(px*px + py*py + pz*pz) as r from particles),
angled as (select *, case when r = 0 then 0.0e0 else acos(greatest(-1.0e0, least(1.0e0, pz / r))) end as theta,
    atan2(py, px) as phi from radial),
vb as (select *, case when theta = 0 then cast('inf' as double) else -ln(tan(theta / 2)) end as eta from angled)"""
VALID_CTE = PARTICLES_CTE + """,
ratioed as (select *, sqrt(px*px + py*py) as pt, atan2(py, px) as phi from particles),
encvars as (select *, case when pt > 0 then asinh(pz / pt) end as eta from ratioed),
bad as (select distinct event_id from encvars where eta is null or abs(eta) > 4),
valid as (select * from encvars where event_id not in (select event_id from bad))"""
ENCODED_CTE = VALID_CTE + f""",
binned as (select *, {bin_sql('pt', PT_BINS)} as pt_bin, {bin_sql('eta', ETA_BINS)} as eta_bin,
    {bin_sql('phi', PHI_BINS)} as phi_bin from valid),
ptok as (select b.event_id, b.particle_idx, 5 + g.slot as t0, 120 + b.pt_bin as t1, 20 + b.eta_bin as t2,
    70 + b.phi_bin as t3, b.sample from binned b join pdg g on b.pdgid = g.pdgid),
etok as (select event_id, list_concat(list_concat([cast(1 as bigint)],
    flatten(list([t0, t1, t2, t3] order by particle_idx))), [cast(2 as bigint)]) as tokens,
    count(*) as n_particles from ptok group by event_id)"""
LOG_CTE = """tlog as (
  select event_type as model, cast((rn - 1) * 10 as bigint) as iter, value * 0.9e0 as train_loss,
    value as val_loss, cast(100 + (event_id % 7) as double) as time, rn - 1 as k
  from (select *, row_number() over (partition by event_type order by ts, event_id) as rn from events) q)"""
