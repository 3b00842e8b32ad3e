"""Text formats: events, generated samples, leading particles, long event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.pinning import pinned
from eventspark.functions.text import line_of_particles, line_of_tokens, particles_of_line, tokens_of_line
from eventspark.operators.joins import join_summary
from eventspark.operators.ordering import running
from eventspark.schema import LEADING_FIELDS, RAW_FIELDS, VERBOSE_FIELDS
from eventspark.scratch import store


def _lines(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Dense ids in line order. Rows stay where they were read: a file block is read by one task in
    order, so a row's id is its place in the block plus the rows of all earlier blocks."""
    placed = store(rows.withColumn("__row", F.monotonically_increasing_id()), "lines")
    blocks = placed.groupBy("__file", "__block").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    ends = running(blocks, ["__file", "__block"], sums={"__end": F.col("__n")})
    starts = ends.select("__file", "__block", "__first", (F.col("__end") - F.col("__n")).alias("__start"))
    kept = [c for c in rows.columns if not c.startswith("__")]
    return join_summary(placed, starts, ["__file", "__block"]).select(
        (F.col("__start") + F.col("__row") - F.col("__first")).alias(name), *kept)


def parse_event_lines(lines: DataFrame, fields: Sequence[str] = RAW_FIELDS, require_semicolon: bool = True) -> DataFrame:
    """Column ``value`` -> ``particles``. Lines without numbers, and on request without ``;``, are skipped."""
    text = F.col("value")
    wanted = F.trim(F.regexp_replace(text, ";", " ")) != ""
    if require_semicolon:
        wanted = wanted & F.contains(text, F.lit(";"))
    return pinned(lines.filter(wanted), "particles", particles_of_line(text, fields)).drop("value")


def read_events(spark: SparkSession, path, fields: Sequence[str] = RAW_FIELDS, require_semicolon: bool = True) -> DataFrame:
    """One event a line -> (event_id, particles), ids in file and line order."""
    return _numbered(parse_event_lines(_lines(spark, path), fields, require_semicolon), "event_id")


def read_verbose_events(spark: SparkSession, path) -> DataFrame:
    return read_events(spark, path, VERBOSE_FIELDS)


def read_samples(spark: SparkSession, path) -> DataFrame:
    """Generated tokens, one sample a line -> (sample_id, tokens)."""
    lines = _lines(spark, path).filter(F.trim("value") != "")
    return _numbered(pinned(lines, "tokens", tokens_of_line(F.col("value"))).drop("value"), "sample_id")


def read_leading(spark: SparkSession, path) -> DataFrame:
    """Space-separated leading-particle table without a header."""
    ddl = ", ".join(f"{f} {'bigint' if f in ('num_particles', 'pdgid') else 'double'}" for f in LEADING_FIELDS)
    return spark.read.schema(ddl).option("sep", " ").csv(path)


def read_events_long(spark: SparkSession, path, max_events: int | None = None) -> DataFrame:
    """CSV with a header and one particle a row, columns taken by name -> (event_id, particles).

    Row order in the file is particle order.
    """
    rows = spark.read.option("header", True).csv(path)
    chosen = rows.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("pdgid").cast("long").alias("pdgid"),
        F.col("energy").cast("double").alias("e"), *[F.col(c).cast("double").alias(c) for c in ("px", "py", "pz")],
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("place"))
    if max_events is not None:
        chosen = chosen.filter(F.col("event_id") < max_events)
    ordered = chosen.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("place", *RAW_FIELDS))).alias("ordered"))
    return ordered.select("event_id", F.transform(
        "ordered", lambda p: F.struct(*[p[f].alias(f) for f in RAW_FIELDS])).alias("particles"))


def _write_lines(rows: DataFrame, order: str, column: str, line, path: str) -> None:
    # range partitions in order: part files read one after another are the rows in order. Lines are
    # made after the exchange, so the sampling pass of the range partitioner does not make them too.
    ordered = rows.select(order, column).repartitionByRange(order).sortWithinPartitions(order)
    ordered.select(line.alias("value")).write.text(path)


def event_lines(events: DataFrame, fields: Sequence[str] = RAW_FIELDS) -> DataFrame:
    return events.select("event_id", line_of_particles(F.col("particles"), fields).alias("value"))


def write_events(events: DataFrame, path: str, fields: Sequence[str] = RAW_FIELDS) -> None:
    """Event lines in event order."""
    _write_lines(events, "event_id", "particles", line_of_particles(F.col("particles"), fields), path)


def write_samples(samples: DataFrame, path: str, order: str = "sample_id") -> None:
    """Token lines in sample order."""
    _write_lines(samples, order, "tokens", line_of_tokens(F.col("tokens")), path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Rejected events as JSON lines: event_idx, failure_reason, event_row."""
    rejects.select(F.col("event_id").alias("event_idx"), F.col("reason").alias("failure_reason"),
                   line_of_tokens(F.col("tokens")).alias("event_row")).write.json(path)
