import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspark.operators import decoding as dc
from eventspark.operators import events as ev
from eventspark.operators import training_runs as tr
from eventspark.plans import fixtures as fx
from eventspark.sources import binary, runs, text
from eventspark.streaming.encode import encoded_stream, event_stream


def event_rows(spark, n=40):
    return ev.nest_events(spark.range(n).select(F.col("id").alias("event_id"), F.explode(F.sequence(F.lit(0), F.col("id") % 4)).alias("particle_idx"))
                          .select("event_id", F.col("particle_idx").cast("long").alias("particle_idx"), F.lit(22).cast("long").alias("pdgid"),
                                  *[(F.col("event_id") * 1.25 + F.col("particle_idx") + i).alias(c) for i, c in enumerate(("e", "px", "py", "pz"))]))


def flat(events):
    return [(r.event_id, [tuple(p) for p in r.particles]) for r in events.orderBy("event_id").collect()]


def test_event_text_round_trip(spark, tmp_path):
    events = event_rows(spark)
    path = str(tmp_path / "ev")
    text.write_events(events, path)
    assert flat(text.read_events(spark, path)) == flat(events)


def test_five_decimals_round_the_exact_value(spark):
    rng = np.random.default_rng(0)
    ties = (np.floor(rng.uniform(-2e9, 2e9, 3000)) + 0.5) / 1e5
    odd = [8689.557125, 3880.1261749999994, 10788.611085000006, 0.015625, -0.015625, 0.046875, 0.000005, 9.999995, 0.0, -0.0, -1e-9, 5e-324, 123456789012.34567,
           999999.999995, 2.0 ** 52 + 0.5, 1e16, 9007199254740993.0, 9.2e18, -0.999999999, 1.0]
    values = [float(v) for v in [*odd, *ties, *np.nextafter(ties, np.inf), *np.nextafter(ties, -np.inf), *rng.normal(0, 1e4, 1000), *rng.normal(0, 1e12, 1000)]]
    df = spark.createDataFrame([(i, [(22, v, -v, 0.0, 1.0)]) for i, v in enumerate(values)],
                               "event_id bigint, particles array<struct<pdgid:bigint,e:double,px:double,py:double,pz:double>>")
    got = [r.value for r in text.event_lines(df).orderBy("event_id").collect()]
    assert got == ["22 %.5f %.5f 0.00000 1.00000;" % (v, -v) for v in values]
    odd = spark.createDataFrame([(0, [(22, None, float("nan"), float("inf"), 1e300)])], df.schema)
    assert text.event_lines(odd).first().value.startswith("22 null NaN Infinity 1000000")


def test_text_ids_follow_lines_over_many_splits(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"22 {i} 1 0 0;\n" if i % 10 else "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = text.read_events(spark, str(path))
        got = [(r.event_id, int(r.particles[0].e)) for r in df.orderBy("event_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(i for i in range(5000) if i % 10))


def test_dense_events(spark, tmp_path):
    events, path = event_rows(spark), str(tmp_path / "dense")
    binary.write_dense_events(events, path)
    assert flat(binary.read_dense_events(spark, path)) == flat(events)
    assert json.loads((tmp_path / "dense.json").read_text())["num_particles_max"] == 4
    with pytest.raises(FileNotFoundError):
        binary.read_dense_events(spark, str(tmp_path / "nothing"))


def test_token_file(spark, tmp_path):
    path = str(tmp_path / "tok")
    seqs = spark.range(1000).select(F.col("id").alias("seq_id"), F.array(F.col("id"), F.col("id") + 1, F.lit(65535)).cast("array<int>").alias("tokens"))
    binary.write_tokens(seqs.repartition(5), path, 3)
    parts = sorted(f for f in os.listdir(path) if f.endswith(".bin"))
    joined = np.concatenate([np.fromfile(os.path.join(path, f), "<u2") for f in parts])
    assert joined.reshape(-1, 3)[:, 0].tolist() == list(range(1000)) and sorted(os.listdir(path)) == parts
    got = binary.read_tokens(spark, path, 3, 990, 995).orderBy("seq_id").collect()
    assert [(r.seq_id, r.tokens[0]) for r in got] == [(i, i) for i in range(990, 995)]
    assert binary.read_tokens(spark, path, 3).count() == 1000
    with pytest.raises(Exception, match="whole records"):
        binary.read_tokens(spark, path, 7).count()
    with pytest.raises(Exception, match="does not fit"):
        binary.write_tokens(seqs.withColumn("tokens", F.array(F.lit(70000), F.lit(1), F.lit(1))), str(tmp_path / "bad"), 3)


def test_samples_and_rejects(spark, tmp_path):
    samples = spark.createDataFrame([(0, [1, 5, 2]), (1, [1, 2])], "sample_id bigint, tokens array<int>")
    text.write_samples(samples, str(tmp_path / "s"))
    assert [r.tokens for r in text.read_samples(spark, str(tmp_path / "s")).orderBy("sample_id").collect()] == [[1, 5, 2], [1, 2]]
    bad = dc.rejects(dc.first_violation(samples.withColumnRenamed("sample_id", "event_id"), fx.VOCAB))
    text.write_rejects(bad, str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert row.event_idx == 0 and row.event_row == "1 5 2" and "wrong number" in row.failure_reason


def test_long_csv_by_name(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("pz,event_id,pdgid,material,energy,eta,theta,phi,pt,px,py\n3,1,22,0,9,0,0,0,0,1,2\n6,1,11,0,8,0,0,0,0,4,5\n1,2,22,0,1,0,0,0,0,1,1\n")
    got = flat(text.read_events_long(spark, str(path)))
    assert got == [(1, [(22, 9, 1, 2, 3), (11, 8, 4, 5, 6)]), (2, [(22, 1, 1, 1, 1)])]
    assert len(flat(text.read_events_long(spark, str(path), max_events=2))) == 1


def test_run_files(spark, tmp_path):
    for name, block in (("m1", 64), ("m2", None)):
        folder = tmp_path / name
        folder.mkdir()
        config = {"training_config": {"batch_size": 4, "context_events": 3} | ({"block_size": block} if block else {})}
        (folder / "model.json").write_text(json.dumps(config, indent=2))
        lines = [{"message": "Model info", "num_params": "12.3M"}, {"message": "Training progress", "iter": 0, "train_loss": 2.0, "val_loss": 3.0, "time": 1.5},
                 {"message": "Training progress: checking checkpoint conditions", "step": 5, "train_loss": 1.0, "val_loss": 2.0}, {"message": "other"}]
        (folder / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "m1" / "metrics_results.json").write_text(json.dumps({"coverage": 0.5}, indent=1))
    metadata = spark.createDataFrame([("m1", 9, 10.0, 7, 2), ("m2", 9, 10.0, 7, 2)],
                                     "model string, vocab_size int, max_sequence_length double, num_train_events bigint, num_val_events bigint")
    config = {r.model: r for r in runs.read_configs(spark, str(tmp_path / "*" / "model.json"), metadata).collect()}
    assert config["m1"].block_size == 64 and config["m2"].block_size == 30 and config["m1"].num_train_tokens == 70
    assert np.isnan(config["m1"].n_layer) and config["m1"].lr_scheduler == "cosine_annealing_with_warmup"
    stem = runs.read_configs(spark, str(tmp_path / "m1" / "model.json"), metadata.withColumn("model", F.lit("model")).limit(1), runs.file_stem())
    assert stem.first().block_size == 64
    (tmp_path / "m1" / "sampling_metadata.json").write_text(json.dumps(
        {"model_name": "m1", "split": "test_bin", "sequence_length": 10, "split_start_token_idx": 70, "num_sample_sequences": 4}, indent=1))
    sampled = runs.read_sampling(spark, str(tmp_path / "*" / "sampling_metadata.json")).first()
    assert (sampled.model, sampled.split, sampled.first_sequence, sampled.end_sequence) == ("m1", "test_bin", 7, 11)
    log = runs.read_training_log(spark, str(tmp_path / "*" / "log.jsonl"))
    assert tr.running_rows(log).count() == 2 and {r.iter for r in tr.checkpoint_rows(log).collect()} == {5}
    assert {r.num_params for r in runs.parameter_counts(log).collect()} == {12300000}
    metrics = {r.model: r for r in runs.read_metrics(spark, str(tmp_path / "*" / "metrics_results.json"), metadata).collect()}
    assert metrics["m1"].coverage == 0.5 and np.isnan(metrics["m1"].mmd) and np.isnan(metrics["m2"].coverage)


def test_encode_runs_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"f{i}.txt").write_text(f"22 10 10 {i} 0;\n22 5 0 0 5;\n")  # the second event has pt = 0
    out = encoded_stream(event_stream(spark, str(source), max_files=1), fx.VOCAB, 14)
    query = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 3 and all(len(r.tokens) == 14 and r.tokens[0] == 1 for r in got)


def test_a_second_write_never_replaces_records(spark, tmp_path):
    from eventspark.sources import binary

    path = str(tmp_path / "tokens")
    rows = lambda n: spark.range(n).select(F.col("id").alias("seq_id"), F.array(F.col("id").cast("int")).alias("tokens"))
    binary.write_tokens(rows(40), path, 1)
    with pytest.raises(FileExistsError):
        binary.write_tokens(rows(3), path, 1)
    assert binary.read_tokens(spark, path, 1).count() == 40
    binary.write_records(rows(3).withColumnRenamed("tokens", "values"), path, "uint16", 1, "seq_id", overwrite=True)
    assert binary.read_tokens(spark, path, 1).count() == 3


def test_ordered_rows_are_made_once(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def note(batches):
        import uuid

        for batch in batches:
            (made / uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch

    rows = spark.range(0, 500, 1, 4).select((499 - F.col("id")).alias("seq_id"), F.array(F.col("id").cast("int")).alias("tokens"))
    binary.write_tokens(rows.mapInArrow(note, rows.schema), str(tmp_path / "tokens"), 1)
    assert sum(int(f.read_text()) for f in made.iterdir()) == 500
    assert [r.tokens[0] for r in binary.read_tokens(spark, str(tmp_path / "tokens"), 1).orderBy("seq_id").collect()] == list(range(499, -1, -1))


def test_events_in_order_need_one_exchange(spark):
    from eventspark.plans import files

    df = files._ordered_events(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    ids = [r.event_id for r in df.select("event_id").collect()]
    assert ids == sorted(set(ids)) and flat(df) == flat(files._events(spark, "/root/testdata/sf0.001"))


def test_large_tables_are_dealt_to_more_parts(spark, monkeypatch):
    same = lambda: sorted(map(tuple, fx.particles(spark, "/root/testdata/sf0.001").collect()))
    before = same()
    monkeypatch.setattr(fx, "PART_BYTES", 2000)
    assert fx._parts(fx.table(spark, "/root/testdata/sf0.001", "lineitem"), 8) > 8 and same() == before
