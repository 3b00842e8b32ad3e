"""Files of training runs: logs, metrics and configurations, one folder a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.text import millions
from eventspark.operators.training_runs import LOG_LINE_DDL
from eventspark.schema import MESSAGE_MODEL_INFO, METRIC_FIELDS

# The fields of a configuration, and what a missing text field stands for.
CONFIG_FIELDS = {
    "batch_size": "double", "gradient_accumulation_steps": "double", "block_size": "double", "context_events": "double",
    "learning_rate": "double", "min_lr": "double", "warmup_iters": "double", "lr_decay_iters": "double",
    "lr_scheduler": "string", "n_layer": "double", "n_head": "double", "n_embd": "double", "scheme": "string",
    "preparation_name": "string",
}
TEXT_DEFAULTS = {"lr_scheduler": "cosine_annealing_with_warmup", "scheme": "unknown", "preparation_name": "unknown"}


def run_name() -> Column:
    """Name of the folder a file lies in; ``key=name`` folders give the name."""
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^[^=]*=", "")


def file_stem() -> Column:
    """Name of the file without its ending."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_training_log(spark: SparkSession, path) -> DataFrame:
    """JSON lines of many runs -> typed rows with the run's name and the place of the line.

    ``line`` orders the rows of a run as its files hold them, files by name: the start of the block that a
    task reads, then the row's place in the task. It compares lines; it does not count them.
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return spark.read.schema(LOG_LINE_DDL).json(path).select(
        run_name().alias("model"), "message", "iter", "step", "train_loss", "val_loss", "time", "num_params", place.alias("line"))


def parameter_counts(log: DataFrame) -> DataFrame:
    """Number of parameters of each run from its log."""
    told = log.filter((F.col("message") == MESSAGE_MODEL_INFO) & F.col("num_params").isNotNull())
    return told.groupBy("model").agg(F.max(millions(F.col("num_params"))).alias("num_params"))


def read_metrics(spark: SparkSession, path, models: DataFrame) -> DataFrame:
    """Metrics of every model; a model without a file gets NaN."""
    ddl = ", ".join(f"{f} double" for f in METRIC_FIELDS)
    found = spark.read.schema(ddl).option("multiLine", True).json(path).select(run_name().alias("model"), *METRIC_FIELDS)
    nan = F.lit(float("nan"))
    return models.select("model").join(found, "model", "left").select(
        "model", *[F.coalesce(F.col(f), nan).alias(f) for f in METRIC_FIELDS])


def read_sampling(spark: SparkSession, path) -> DataFrame:
    """Sampling metadata of every run: which split the sample came from and the sequences it stands for."""
    ddl = ("model_name string, split string, sequence_length bigint, split_start_token_idx bigint, "
           "num_sample_sequences bigint, num_starter_tokens bigint, seed bigint")
    raw = spark.read.schema(ddl).option("multiLine", True).json(path).select(
        F.coalesce("model_name", run_name()).alias("model"), "split", "sequence_length", "split_start_token_idx",
        "num_sample_sequences", "num_starter_tokens", "seed")
    first = F.floor(F.col("split_start_token_idx") / F.col("sequence_length")).cast("long")
    return raw.withColumns({"first_sequence": first, "end_sequence": first + F.col("num_sample_sequences")})


def read_configs(spark: SparkSession, path, metadata: DataFrame, name: Column | None = None) -> DataFrame:
    """Configuration of every run, flattened: missing numbers are NaN, a missing block size is the
    number of context events times the sequence length, token counts are length times events.

    A run is named by ``model_name`` in its file, otherwise by ``name`` (default: the folder).
    ``metadata`` has (model, vocab_size, max_sequence_length, num_train_events, num_val_events).
    """
    inner = ", ".join(f"{k}: {t}" for k, t in CONFIG_FIELDS.items())
    raw = spark.read.schema(f"model_name string, training_config struct<{inner}>").option("multiLine", True).json(path).select(
        F.coalesce(F.col("model_name"), run_name() if name is None else name).alias("model"), "training_config.*")
    nan = F.lit(float("nan"))
    filled = raw.select("model", *[
        F.coalesce(F.col(k), F.lit(TEXT_DEFAULTS[k]) if t == "string" else nan).alias(k) for k, t in CONFIG_FIELDS.items()])
    length = F.col("max_sequence_length")
    block = F.when(F.isnan("block_size"), F.col("context_events") * length).otherwise(F.col("block_size"))
    return filled.join(metadata, "model").withColumns({
        "block_size": block, "num_train_tokens": length * F.col("num_train_events"),
        "num_val_tokens": length * F.col("num_val_events")})
