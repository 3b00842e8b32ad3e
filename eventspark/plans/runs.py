"""Queries on training logs, smoothing and run summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventspark.functions.text import millions
from eventspark.operators import smoothing as sm
from eventspark.operators import training_runs as tr
from eventspark.plans import fixtures as fx
from eventspark.plans.particles import r, rounded
from eventspark.schema import MESSAGE_CHECKPOINT, MESSAGE_MODEL_INFO, MESSAGE_RUNNING, METRIC_FIELDS
from eventspark.scratch import scratch_path, store
from eventspark.sources import runs as sr

LOSSES = ["train_loss", "val_loss"]


def _log(spark, sf):
    return fx.training_log(spark, sf)


def _checkpoints(spark, sf):
    """A checkpoint is considered four iterations after every logged row."""
    return _log(spark, sf).select("model", (F.col("iter") + 4).alias("iter"), *LOSSES)


def _series(spark, sf):
    return _log(spark, sf).withColumn("k", F.floor(F.col("iter") / 10).cast("long")).select("model", "iter", "k", "val_loss")


def _log_lines(spark, sf):
    """The log as rows of the file format: running, checkpoint and model-info messages."""
    log = _log(spark, sf)
    running = log.select("model", F.lit(MESSAGE_RUNNING).alias("message"), "iter", F.lit(None).cast("bigint").alias("step"),
                         *LOSSES, "time", F.lit(None).cast("string").alias("num_params"))
    check = _checkpoints(spark, sf).select(
        "model", F.lit(MESSAGE_CHECKPOINT).alias("message"), F.lit(None).cast("bigint").alias("iter"),
        F.col("iter").alias("step"), *LOSSES, F.lit(None).cast("double").alias("time"), F.lit(None).cast("string").alias("num_params"))
    none = F.lit(None)
    info = log.groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        "model", F.lit(MESSAGE_MODEL_INFO).alias("message"), none.cast("bigint").alias("iter"), none.cast("bigint").alias("step"),
        none.cast("double").alias("train_loss"), none.cast("double").alias("val_loss"), none.cast("double").alias("time"),
        F.concat(F.floor(F.col("n") / 10).cast("string"), F.lit("."), (F.col("n") % 10).cast("string"), F.lit("M")).alias("num_params"))
    return running.unionByName(check).unionByName(info)


def _written(df, label):
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy("model").json(path)
    return f"{path}/*/*.json"


def src_train_log(spark, sf):
    log = sr.read_training_log(spark, _written(_log_lines(spark, sf), "log"))
    run = tr.running_rows(log).withColumn("kind", F.lit("running"))
    check = tr.checkpoint_rows(log).withColumn("kind", F.lit("checkpoint")).withColumn("time", F.lit(None).cast("double"))
    return rounded(run.unionByName(check).drop("line"), LOSSES)


def src_metrics_json(spark, sf):
    log = _log(spark, sf)
    models = log.select("model").distinct()
    sums = log.filter("model <> 'error'").groupBy("model").agg(
        *[F.round(F.avg("val_loss") + k, 6).alias(m) for k, m in enumerate(METRIC_FIELDS)])
    out = sr.read_metrics(spark, _written(sums, "metrics"), models)
    return out.select("model", *[F.when(~F.isnan(m), r(F.col(m))).alias(m) for m in METRIC_FIELDS])


def _config(spark, sf):
    """Settings that follow from the number of log rows; views have no block size of their own."""
    n = F.col("n")
    per_model = _log(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    config = per_model.select("model", F.struct(
        (8 + n % 8).cast("double").alias("batch_size"), F.when(F.col("model") != "view", 108.0).alias("block_size"),
        F.lit(3.0).alias("context_events"), (n / 1e6).alias("learning_rate"),
        F.when(F.col("model") == "click", "cosine").alias("lr_scheduler")).alias("training_config"))
    metadata = per_model.select("model", F.lit(144).alias("vocab_size"), F.lit(54.0).alias("max_sequence_length"),
                                (n * 10).alias("num_train_events"), n.alias("num_val_events"))
    return sr.read_configs(spark, _written(config, "config"), metadata)


def src_run_config(spark, sf):
    """Configuration, parameter count from the log and sampling metadata of every run."""
    sampling = _log(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n")).select(
        "model", F.lit("test_bin").alias("split"), F.lit(54).alias("sequence_length"),
        (F.col("n") * 54 * 9).alias("split_start_token_idx"), F.col("n").alias("num_sample_sequences"))
    out = (_config(spark, sf).join(sr.parameter_counts(sr.read_training_log(spark, _written(_log_lines(spark, sf), "log"))), "model")
           .join(sr.read_sampling(spark, _written(sampling, "sampling")), "model"))
    return out.select("num_params", "split", "first_sequence", "end_sequence", "model", "batch_size", "block_size", r(F.col("learning_rate")).alias("learning_rate"), "lr_scheduler", "scheme",
                      F.isnan("n_layer").alias("n_layer_missing"), "num_train_tokens", "num_val_tokens",
                      F.col("vocab_size").cast("long").alias("vocab_size"))


def parse_log_line(spark, sf):
    lines = _log(spark, sf).select("model", F.to_json(F.struct(
        F.lit(MESSAGE_RUNNING).alias("message"), "iter", *LOSSES, "time")).alias("value"))
    return rounded(tr.parse_log_lines(lines).select("model", "message", "iter", *LOSSES, "time"), LOSSES)


def parse_millions(spark, sf):
    text = F.concat((F.col("o_custkey") % 400).cast("string"), F.lit("."), (F.col("o_orderkey") % 10).cast("string"), F.lit("M"))
    orders = fx.table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", "text", millions(F.col("text")).alias("n"))


def best_checkpoint(spark, sf):
    c = _checkpoints(spark, sf)
    by_val = tr.best_checkpoint(c).withColumn("by", F.lit("val_loss"))
    by_train = tr.best_checkpoint(c, "train_loss").withColumn("by", F.lit("train_loss"))
    return rounded(by_val.unionByName(by_train), LOSSES)


def join_nearest_iter(spark, sf):
    return tr.nearest_iteration(_log(spark, sf), tr.best_checkpoint(_checkpoints(spark, sf)))


def train_totals(spark, sf):
    """From log files, whose lines say what came before."""
    lines = _log_lines(spark, sf).withColumn("at", F.coalesce("iter", "step")).repartitionByRange("model", "at").sortWithinPartitions("model", "at")
    log = store(sr.read_training_log(spark, _written(lines.drop("at"), "log")), "log")
    return tr.train_totals(tr.running_rows(log), tr.best_checkpoint(tr.checkpoint_rows(log), order="line"), "line")


def join_model_summary(spark, sf):
    log, config = _log(spark, sf), _config(spark, sf)
    metadata = config.select("model", "vocab_size", "num_train_tokens", "num_val_tokens")
    metrics = log.filter("model <> 'error'").groupBy("model").agg(F.max("val_loss").alias("coverage"))
    out = tr.model_summary(metadata, config.select("model", "batch_size", "block_size"), metrics, log, _checkpoints(spark, sf))
    out = out.withColumn("coverage", F.when(~F.isnan("coverage"), F.col("coverage")))
    return rounded(out.withColumn("vocab_size", F.col("vocab_size").cast("long")), ["min_saved_train_loss", "min_saved_val_loss", "coverage"])


def smooth_ema(spark, sf):
    return rounded(sm.ema(_series(spark, sf), "model", "k", "val_loss", 0.02).select("model", "k", "smooth"), ["smooth"])


def smooth_rolling(spark, sf):
    s = _series(spark, sf)
    out = None
    for method in ("mean", "median", "median_then_mean"):
        part = sm.rolling(s, "model", "k", "val_loss", 101, method).select("model", "k", F.lit(method).alias("method"), "smooth")
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["smooth"], 9)  # medians have few decimals: fewer digits would meet exact ties


def smooth_savgol(spark, sf):
    return rounded(sm.savgol(_series(spark, sf), "model", "k", "val_loss", 301, 3).select("model", "k", "smooth"), ["smooth"])


def smooth_bin_average(spark, sf):
    out = sm.bin_average(_series(spark, sf), "model", "k", ["iter", "val_loss"], 25)
    return rounded(out, ["iter", "val_loss"])


QUERIES = {f.__name__: f for f in (
    src_train_log, src_metrics_json, src_run_config, parse_log_line, parse_millions, best_checkpoint, join_nearest_iter,
    train_totals, join_model_summary, smooth_ema, smooth_rolling, smooth_savgol, smooth_bin_average)}

#: Weights that give the coefficients of a cubic fit to 301 values at -150 .. 150.
_FIT = np.linalg.pinv(np.vander(np.arange(-150, 151), 4, increasing=True))


def _fitted(values, at):
    """The fitted polynomial at a place, as SQL."""
    return " + ".join(f"list_dot_product({values}, {fx.array_sql(w)}) * pow({at}, {j})" for j, w in enumerate(_FIT))


_L = f"with {fx.LOG_CTE}"
_BEST = """, ck as (select model, iter + 4 as iter, train_loss, val_loss from tlog),
  best as (select * from ck qualify row_number() over (partition by model order by val_loss, iter) = 1),
  nearest as (select l.model, b.iter as best_iter, l.iter as nearest_iter from tlog l join best b on l.model = b.model
    qualify row_number() over (partition by l.model order by abs(l.iter - b.iter), l.iter) = 1),
  totals as (select l.model, max(l.iter) as iters_trained, sum(l.time) as compute_time_trained,
    coalesce(sum(l.time) filter (where l.iter < n.nearest_iter), 0.0e0) as compute_time_saved from tlog l join nearest n on n.model = l.model group by l.model)"""
_CONF = """, pm as (select model, count(*) as n from tlog group by model),
  conf as (select model, cast(8 + n % 8 as double) as batch_size, case when model = 'view' then 3 * 54.0e0 else 108.0e0 end as block_size,
    n / 1e6 as learning_rate, case when model = 'click' then 'cosine' else 'cosine_annealing_with_warmup' end as lr_scheduler,
    54.0e0 * n * 10 as num_train_tokens, 54.0e0 * n as num_val_tokens from pm)"""

ORACLE = {
    "src_train_log": _L + """ select model, 'running' as kind, iter, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss, time from tlog
        union all select model, 'checkpoint', iter + 4, round(train_loss, 6), round(val_loss, 6), null from tlog""",
    "src_metrics_json": _L + ", m as (select model, case when model <> 'error' then avg(val_loss) end as v from tlog group by model) select model, "
        + ", ".join(f"round(v + {k}, 6) as {m}" for k, m in enumerate(METRIC_FIELDS)) + " from m",
    "src_run_config": _L + _CONF + """ select model, batch_size, block_size, round(learning_rate, 6) as learning_rate, lr_scheduler, 'unknown' as scheme,
        true as n_layer_missing, num_train_tokens, num_val_tokens, cast(144 as bigint) as vocab_size,
        cast(trunc(cast((n // 10) || '.' || (n % 10) as double) * 1e6) as bigint) as num_params, 'test_bin' as split,
        n * 9 as first_sequence, n * 10 as end_sequence from conf join pm using (model)""",
    "parse_log_line": _L + """ select model, 'Training progress' as message, iter, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss,
        time from tlog""",
    "parse_millions": """select o_orderkey, (o_custkey % 400) || '.' || (o_orderkey % 10) || 'M' as text,
        cast(trunc(cast((o_custkey % 400) || '.' || (o_orderkey % 10) as double) * 1e6) as bigint) as n from orders""",
    "best_checkpoint": _L + _BEST + """ select model, iter, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss, 'val_loss' as by from best
        union all select model, iter, round(train_loss, 6), round(val_loss, 6), 'train_loss' from (
          select * from ck qualify row_number() over (partition by model order by train_loss, iter) = 1)""",
    "join_nearest_iter": _L + _BEST + " select model, best_iter, nearest_iter from nearest",
    "train_totals": _L + _BEST + " select model, iters_trained, compute_time_trained, compute_time_saved from totals",
    "join_model_summary": _L + _BEST + _CONF + """, met as (select model, max(val_loss) as coverage from tlog where model <> 'error' group by model)
        select c.model, cast(144 as bigint) as vocab_size, c.num_train_tokens, c.num_val_tokens, c.batch_size, c.block_size, t.iters_trained,
          t.compute_time_trained, t.compute_time_saved, b.iter as iters_saved, round(b.train_loss, 6) as min_saved_train_loss,
          round(b.val_loss, 6) as min_saved_val_loss, round(met.coverage, 6) as coverage,
          cast(floor(c.num_train_tokens / (c.batch_size * c.block_size)) as bigint) as iterations_per_epoch
        from conf c join totals t on t.model = c.model join best b on b.model = c.model left join met on met.model = c.model""",
    "smooth_ema": _L + """ select a.model, a.k, round(sum(pow(0.98e0, a.k - b.k) * b.val_loss * case when b.k = 0 then 1 else 0.02e0 end), 6) as smooth
        from tlog a join tlog b on a.model = b.model and b.k <= a.k group by a.model, a.k""",
    "smooth_rolling": _L + """, w as (select model, k, avg(val_loss) over f as m, median(val_loss) over f as d from tlog
          window f as (partition by model order by k rows between 50 preceding and 50 following)),
        z as (select *, avg(d) over (partition by model order by k rows between 50 preceding and 50 following) as dm from w)
        select model, k, 'mean' as method, round(m, 9) as smooth from z union all select model, k, 'median', round(d, 9) from z
        union all select model, k, 'median_then_mean', round(dm, 9) from z""",
    "smooth_savgol": _L + f""", s as (select model, k, val_loss, count(*) over (partition by model) as n from tlog),
        ends as (select model, list(val_loss order by k) filter (where k < 301) as f, list(val_loss order by k) filter (where k >= n - 301) as l
          from s group by model),
        mid as (select *, list(val_loss) over (partition by model order by k rows between 150 preceding and 150 following) as w from s)
        select m.model, m.k, round(case when n < 301 then val_loss when k < 150 then {_fitted("f", "k - 150")}
          when k >= n - 150 then {_fitted("l", "k - n + 151")} else list_dot_product(w, {fx.array_sql(_FIT[0])}) end, 6) as smooth
        from mid m join ends e on m.model = e.model""",
    "smooth_bin_average": _L + """ select model, k // 25 as "group", round(avg(iter), 6) as iter, round(avg(val_loss), 6) as val_loss
        from tlog group by model, k // 25 having count(*) = 25""",
}
