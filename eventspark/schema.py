"""Row types and the fixed values of the data formats."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# --- fixed values -----------------------------------------------------------
# They must equal the published formats for results to agree.
RAW_FIELDS = ("pdgid", "e", "px", "py", "pz")
VERBOSE_FIELDS = ("pdgid", "e", "px", "py", "pz", "pt", "eta", "theta", "phi")
LEADING_FIELDS = ("num_particles", "pdgid", "e", "px", "py", "pz", "pt", "eta", "theta", "phi")
FEATURE_ORDER = ("e", "eta", "theta", "phi", "pt", "px", "py", "pz")
STRUCTURAL_SLOTS = ("particle_start", "particle_end")
ETA_LIMIT = 4.0
TARGET_MASS = 931.5 * 12  # carbon target at rest, MeV
GAUSSIAN_GRID_POINTS = 10_000
REASON_LENGTH = "Particle has the wrong number of tokens."
REASON_RANGE = "Expected valid {slot} tokens in [{lo}, {hi}). Got something else."
REASON_RESERVED = "PDGID token maps to reserved PDG slot."
MESSAGE_RUNNING = "Training progress"
MESSAGE_CHECKPOINT = "Training progress: checking checkpoint conditions"
MESSAGE_MODEL_INFO = "Model info"
METRIC_FIELDS = (
    "coverage", "mmd", "kpd_median", "kpd_error", "fpd_value", "fpd_error",
    "w1m_score", "w1m_score_std",
    "w1p_avg_eta", "w1p_avg_phi", "w1p_avg_pt",
    "w1p_avg_eta_std", "w1p_avg_phi_std", "w1p_avg_pt_std",
)
# ----------------------------------------------------------------------------

PARTICLE = "struct<" + ",".join(
    f"{f}:{'bigint' if f == 'pdgid' else 'double'}" for f in RAW_FIELDS) + ">"
VERBOSE_PARTICLE = "struct<" + ",".join(
    f"{f}:{'bigint' if f == 'pdgid' else 'double'}" for f in VERBOSE_FIELDS) + ">"
EVENTS_DDL = f"event_id bigint, particles array<{PARTICLE}>"
SEQUENCES_DDL = "seq_id bigint, tokens array<int>"


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of plan-time constants as a local relation: planned and broadcast without a job."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), schema)
