"""Training logs and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.operators.joins import join_summary
from eventspark.operators.ordering import with_position
from eventspark.schema import MESSAGE_CHECKPOINT, MESSAGE_RUNNING, METRIC_FIELDS

LOG_LINE_DDL = ("message string, iter bigint, step bigint, train_loss double, val_loss double, "
                "time double, num_params string")


def with_epoch(log: DataFrame, iterations_per_epoch: int) -> DataFrame:
    """Epoch number, iteration inside the epoch, and fractional epoch."""
    if iterations_per_epoch <= 0:
        raise ValueError("iterations_per_epoch must be positive")
    n = F.lit(iterations_per_epoch)
    return log.withColumns({
        "epoch": F.floor(F.col("iter") / n).cast("long"), "iter_in_epoch": F.col("iter") % n,
        "epoch_fraction": F.col("iter") / n})


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines -> typed columns."""
    keep = [c for c in lines.columns if c != column]
    return lines.select(*keep, F.from_json(column, LOG_LINE_DDL).alias("j")).select(*keep, "j.*")


def running_rows(log: DataFrame) -> DataFrame:
    """Log rows of the running losses."""
    keep = [c for c in ("model", "line") if c in log.columns]
    return log.filter((F.col("message") == MESSAGE_RUNNING) & F.col("iter").isNotNull()).select(
        *keep, "iter", "train_loss", "val_loss", "time")


def checkpoint_rows(log: DataFrame) -> DataFrame:
    """Log rows written when a checkpoint was considered."""
    keep = [c for c in ("model", "line") if c in log.columns]
    return log.filter(F.col("message") == MESSAGE_CHECKPOINT).select(
        *keep, F.col("step").alias("iter"), "train_loss", "val_loss")


def best_checkpoint(checkpoints: DataFrame, loss: str = "val_loss", order: str = "iter") -> DataFrame:
    """Row of the lowest loss for each model, the earliest of equals; a null or NaN loss is never the lowest."""
    row = F.struct("iter", "train_loss", "val_loss")
    return checkpoints.filter(F.col(loss).isNotNull() & ~F.isnan(loss)).groupBy("model").agg(F.min_by(row, F.struct(loss, order)).alias("b")).select("model", "b.*")


def nearest_iteration(log: DataFrame, best: DataFrame, order: str = "iter") -> DataFrame:
    """The logged iteration closest to the best checkpoint, the earlier of equally close ones; with another
    ``order`` also the row's place in it."""
    joined = join_summary(log, best.select("model", F.col("iter").alias("best_iter")), ["model"])
    distance = F.abs(F.col("iter") - F.col("best_iter"))
    place = [F.col("m.at").alias("nearest_at")] if order != "iter" else []
    return joined.groupBy("model").agg(
        F.min(F.struct(distance.alias("distance"), F.col(order).alias("at"), "iter")).alias("m"), F.first("best_iter").alias("best_iter")
    ).select("model", "best_iter", F.col("m.iter").alias("nearest_iter"), *place)


def train_totals(log: DataFrame, best: DataFrame, order: str = "iter") -> DataFrame:
    """Iterations and time of the run, and the time spent before the logged row nearest the best checkpoint.

    "Before" goes by ``order``. A run that was resumed logs iterations again: then only "line" tells
    which rows come before.
    """
    nearest = nearest_iteration(log, best, order)
    before = F.sum(F.when(F.col(order) < F.col("nearest_iter" if order == "iter" else "nearest_at"), F.col("time")))
    return join_summary(log, nearest, ["model"]).groupBy("model").agg(
        F.max("iter").alias("iters_trained"), F.sum("time").alias("compute_time_trained"),
        F.coalesce(before, F.lit(0.0)).alias("compute_time_saved"))


def model_summary(metadata: DataFrame, config: DataFrame, metrics: DataFrame, log: DataFrame,
                  checkpoints: DataFrame) -> DataFrame:
    """One row for each model: metadata, configuration, metrics and training results."""
    best = best_checkpoint(checkpoints)
    saved = best.select("model", F.col("iter").alias("iters_saved"),
                        F.col("train_loss").alias("min_saved_train_loss"), F.col("val_loss").alias("min_saved_val_loss"))
    per_step = F.col("batch_size") * F.col("block_size")
    wide = (metadata.join(config, "model").join(train_totals(log, best), "model").join(saved, "model")
            .join(metrics, "model", "left"))
    return wide.withColumn("iterations_per_epoch", F.floor(F.col("num_train_tokens") / per_step).cast("long")).fillna(
        float("nan"), [c for c in METRIC_FIELDS if c in metrics.columns])


def with_row_number(log: DataFrame, name: str = "k") -> DataFrame:
    """Place of a row in its series."""
    return with_position(log, ["iter"], ["model"], name)
