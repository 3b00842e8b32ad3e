"""Token files from their metadata: what is read, what is refused, and the windows of sampling runs."""

import json
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from eventspark.operators import sequences as sq
from eventspark.plans import fixtures as fx
from eventspark.sources import token_files as tf

LENGTH, N = 5, 100


@pytest.fixture()
def written(spark, tmp_path):
    rows = spark.range(N).selectExpr("id as seq_id", f"transform(sequence(0, {LENGTH - 1}), i -> cast((id + i) % 144 as int)) as tokens")
    return tf.write_token_file(rows.repartition(3), str(tmp_path / "tokens"), LENGTH, fx.VOCAB)


def edited(metadata, tmp_path, **changes):
    path = tmp_path / "edited.json"
    path.write_text(json.dumps(json.load(open(metadata)) | changes))
    return str(path)


def test_everything_comes_from_the_metadata(spark, written, tmp_path):
    assert [tuple(r) for r in tf.read_token_file(spark, written).orderBy("seq_id").collect()] == [
        (i, [(i + k) % 144 for k in range(LENGTH)]) for i in range(N)]
    # other types and byte orders, a single file, a path below a root
    for kind, name, order in ((">u2", "uint16", "big"), ("<i4", "int32", "little"), (">u4", "uint32", "big"), ("<u1", "uint8", "little")):
        np.arange(20).astype(kind).tofile(tmp_path / "one.bin")
        meta = edited(written, tmp_path, tokenized_dtype=name, byte_order=order, output_data_filepath="one.bin", total_tokens=20, num_full_sequences=4)
        df = tf.read_token_file(spark, meta, root=str(tmp_path))
        assert [r["tokens"] for r in df.orderBy("seq_id").collect()] == np.arange(20).reshape(4, 5).tolist()
        assert df.schema["tokens"].dataType.elementType.simpleString() == ("bigint" if name == "uint32" else "int")


@pytest.mark.parametrize("changes, message", [
    ({"total_tokens": 499}, "states 499"), ({"sequence_length": 7}, "whole sequences"), ({"num_full_sequences": 99}, "states 99"),
    ({"tokenized_dtype": "float32"}, "integer"), ({"vocab_size": 70_000}, "does not fit"), ({"vocab_size": 0}, "positive"),
    ({"tokenized_dtype": "int32", "total_tokens": 500}, "holds 250 tokens")])
def test_metadata_that_contradict_the_file_are_refused(written, tmp_path, changes, message):
    with pytest.raises((ValueError, TypeError), match=message):
        tf.TokenFile.read(edited(written, tmp_path, **changes))


def bytes_read(metadata, filters, ranges=None, named=False):
    """Bytes that the source reads for the filters, measured where it reads, and the filters that are left."""
    file = tf.TokenFile.read(metadata)
    reader = tf.TokenFileReader(file, ranges or [(None, 0, file.num_full_sequences)], named, 64 << 20)
    left = list(reader.pushFilters(filters))
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    return sum(len(b.column("tokens").flatten()) for b in rows) * 2, left


def test_a_range_of_sequences_reads_only_its_bytes(spark, written):
    low, high = GreaterThan(("seq_id",), 39), LessThanOrEqual(("seq_id",), 49)
    assert bytes_read(written, [IsNotNull(("seq_id",)), low, high]) == (10 * LENGTH * 2, [])
    assert bytes_read(written, [EqualTo(("seq_id",), 7)]) == (LENGTH * 2, [])
    odd = In(("seq_id",), (1, 2))
    assert bytes_read(written, [odd])[1] == [odd]
    df = tf.read_token_file(spark, written).where("seq_id between 40 and 49")
    assert sorted(r["seq_id"] for r in df.collect()) == list(range(40, 50))
    assert not re.search(r"\bFilter\b", df._jdf.queryExecution().executedPlan().toString())  # the source keeps the whole condition
    ranges = [("train", 0, 80), ("test", 90, 100)]
    assert bytes_read(written, [EqualTo(("split",), "test")], ranges, True) == (10 * LENGTH * 2, [])


def test_splits_by_name(spark, written, tmp_path):
    path = str(tmp_path / "preparation.json")
    tf.write_preparation(path, written, {"train": sq.Split(60), "validation": sq.Split(20, 10, True), "test": sq.Split(10, 0, True)})
    ids = lambda name: sorted(r["seq_id"] for r in tf.read_split(spark, path, name).collect())
    assert ids("train_bin") == list(range(60)) and ids("validation") == list(range(70, 90)) and ids("test") == list(range(90, 100))
    both = tf.read_splits(spark, path).where("split in ('test', 'validation') and seq_id >= 85").groupBy("split").count()
    assert {r["split"]: r["count"] for r in both.collect()} == {"validation": 5, "test": 10}
    with pytest.raises(ValueError, match="no split"):
        tf.read_split(spark, path, "holdout")
    tf.write_preparation(path, written, {"train": sq.Split(10, 95)})
    with pytest.raises(ValueError, match="does not fit"):
        tf.read_split(spark, path, "train")
    tf.write_preparation(path, written, {"train": sq.Split(10)})
    with pytest.raises(ValueError, match="no split"):
        tf.read_split(spark, path, "test")


def windows(spark, **changes):
    run = {"model": "m", "split": "test_bin", "sequence_length": LENGTH, "split_start_token_idx": 90 * LENGTH, "num_sample_sequences": 4} | changes
    runs = spark.createDataFrame([tuple(run.values())], "model string, split string, sequence_length long, split_start_token_idx long, num_sample_sequences long")
    splits = spark.createDataFrame([("train_bin", 0, 80), ("test_bin", 90, 100)], "split string, lo long, hi long")
    return sq.sampled_windows(runs, splits, LENGTH)


def test_the_window_of_a_sampling_run(spark, written):
    tokens = tf.read_token_file(spark, written)
    both = windows(spark).unionByName(windows(spark, model="n", num_sample_sequences=10))
    for step in (3, 65_536):
        got = sq.in_windows(tokens, both, step).select("model", "place", "seq_id").collect()
        assert sorted(map(tuple, got)) == [("m", k, 90 + k) for k in range(4)] + [("n", k, 90 + k) for k in range(10)]


@pytest.mark.parametrize("changes, message", [
    ({"num_sample_sequences": 11}, "more sequences were sampled"), ({"split_start_token_idx": 95 * LENGTH}, "does not begin"),
    ({"split": "other"}, "unknown split"), ({"sequence_length": 6}, "another sequence length")])
def test_windows_that_cannot_be_compared_are_refused(spark, changes, message):
    with pytest.raises(PySparkException, match=message):
        windows(spark, **changes).collect()


def test_a_failed_write_leaves_the_old_records(spark, tmp_path):
    path = str(tmp_path / "records")
    good = spark.range(6).selectExpr("id as seq_id", "array(1, 2) as tokens")
    tf.write_token_file(good, path, 2, fx.VOCAB)
    with pytest.raises(FileExistsError):
        tf.write_token_file(good, path, 2, fx.VOCAB)
    with pytest.raises(PySparkException):
        tf.write_token_file(good.selectExpr("seq_id", "array(1) as tokens"), path, 2, fx.VOCAB, overwrite=True)
    assert tf.read_token_file(spark, f"{path}.json").count() == 6
    meta = tf.write_token_file(good.limit(2), path, 2, fx.VOCAB, overwrite=True)
    assert tf.read_token_file(spark, meta).count() == 2


# --- a growing file, decoded ----------------------------------------------------------

def padded_events(spark, n, length=14):
    from eventspark.operators import encoding as en

    rows = [(i, [(2212, 500.0, 100.0 + i, 0.0, 50.0), (211, 300.0, -50.0, 80.0, 10.0)]) for i in range(n)]
    events = spark.createDataFrame(rows, "event_id long, particles array<struct<pdgid:long,e:double,px:double,py:double,pz:double>>")
    return en.pad_sequences(en.encode_events(events, fx.VOCAB), length, fx.VOCAB).withColumnRenamed("event_id", "seq_id")


def test_a_growing_file_is_decoded_once_over_restarts(spark, tmp_path):
    from eventspark.operators.tokenizers import PerEventTokenizer, tokenizer
    from eventspark.streaming.decode import decode_stream, token_stream

    whole = [r["tokens"] for r in padded_events(spark, 30).orderBy("seq_id").collect()]
    whole[4] = [5, *whole[4][1:]][:13] + [0]  # decodable as it is: the first token is not looked at
    whole[11] = whole[11][:3] + [130] + whole[11][4:]  # a pt token in the place of eta
    data = np.array(whole, dtype="<u2")
    path = tmp_path / "tokens"
    path.mkdir()
    meta = tmp_path / "tokens.json"
    meta.write_text(json.dumps({"tokenizer_class": PerEventTokenizer.name, "tokenized_dtype": "uint16", "byte_order": "little", "vocab_size": fx.VOCAB.size,
                                "sequence_length": 14, "total_sequences": 0, "total_tokens": 0, "num_full_sequences": 0, "output_data_filepath": str(path)}))

    def run():
        tok = tokenizer(PerEventTokenizer.name, fx.VOCAB, 14)
        query = decode_stream(token_stream(spark, str(meta)), tok, fx.pdg(spark), str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None

    def seen():
        good = spark.read.parquet(f"{tmp_path}/out/particles").groupBy("event_id").count().collect()
        bad = spark.read.parquet(f"{tmp_path}/out/rejects").select("event_id", "reason").collect()
        return {r["event_id"]: r["count"] for r in good}, {r["event_id"]: r["reason"] for r in bad}

    data[:9].tofile(path / "part-0.bin")
    with open(path / "part-0.bin", "ab") as f:
        f.write(data[9].tobytes()[:5])  # half a record is not there yet
    run()
    assert set(seen()[0]) == set(range(9))
    data[:15].tofile(path / "part-0.bin")
    data[15:20].tofile(path / "part-1.bin")
    run()
    run()  # nothing new
    data[20:].tofile(path / "part-2.bin")
    run()
    good, bad = seen()
    assert good == {i: 2 for i in range(30) if i != 11} and list(bad) == [11] and "eta" in bad[11]


def test_tokenizers_by_name(spark):
    from eventspark.operators import tokenizers as tz

    with pytest.raises(ValueError, match="no tokenizer"):
        tz.tokenizer("Unheard", fx.VOCAB, 14)

    @tz.register_tokenizer("PositivePz")
    class PositivePz(tz.PerEventTokenizer):
        def postprocess(self, particles):
            return particles.filter("pz > 0")

    with pytest.raises(ValueError, match="already"):
        tz.register_tokenizer("PositivePz")(tz.PackedTokenizer)
    own, plain = (tz.tokenizer(name, fx.VOCAB, 14).decode(padded_events(spark, 3), fx.pdg(spark))[0] for name in ("PositivePz", tz.PerEventTokenizer.name))
    assert isinstance(tz.tokenizer("PositivePz", fx.VOCAB, 14), PositivePz)
    assert sorted(map(tuple, own.collect())) == sorted(tuple(r) for r in plain.collect() if r["pz"] > 0) and plain.count() == 6


def test_totals_of_a_resumed_run_go_by_line(spark, tmp_path):
    """Iterations 20 and 30 are logged twice; the nearest row is the first of its iteration."""
    from eventspark.operators import training_runs as tr
    from eventspark.sources import runs as sr

    (tmp_path / "m").mkdir()
    line = lambda **kw: json.dumps(kw) + "\n"
    run = lambda i, t: line(message="Training progress", iter=i, train_loss=1.0, val_loss=1.0, time=t)
    check = lambda s, v: line(message="Training progress: checking checkpoint conditions", step=s, train_loss=1.0, val_loss=v)
    (tmp_path / "m" / "train_log_1.jsonl").write_text(
        run(0, 1.0) + run(10, 2.0) + run(20, 4.0) + run(30, 8.0) + run(20, 16.0) + run(30, 32.0) + run(40, 64.0) + check(41, 0.5) + check(11, 0.5) + run(50, 128.0))
    log = sr.read_training_log(spark, str(tmp_path / "m")).cache()
    best = tr.best_checkpoint(tr.checkpoint_rows(log), order="line")
    assert best.first().iter == 41  # the first of equal losses in the file, not the smallest iteration
    got = tr.train_totals(tr.running_rows(log), best, "line").first()
    assert (got.iters_trained, got.compute_time_trained, got.compute_time_saved) == (50, 255.0, 63.0)
    twice = tr.train_totals(tr.running_rows(log), best.selectExpr("model", "20L as iter", "train_loss", "val_loss"), "line").first()
    assert twice.compute_time_saved == 3.0  # the first of both rows of iteration 20
