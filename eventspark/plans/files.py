"""Queries that write the given events to a file format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.functions.text import line_of_particles, line_of_tokens
from eventspark.operators import decoding as dc
from eventspark.operators import encoding as en
from eventspark.operators import events as ev
from eventspark.operators import sequences as sq
from eventspark.operators.tokenizers import PackedTokenizer, PerEventTokenizer, tokenizer
from eventspark.plans import fixtures as fx
from eventspark.plans import tokens as tk
from eventspark.plans.particles import r, rounded
from eventspark.schema import LEADING_FIELDS, VERBOSE_FIELDS, small_table
from eventspark.scratch import scratch_path, store
from eventspark.sources import binary, text, token_files
from eventspark.sources.runs import read_sampling

V = fx.VOCAB


def _events(spark, sf):
    return ev.nest_events(fx.particles(spark, sf))


def _ordered_events(spark, sf):
    """Events in range partitions sorted by their id, made once."""
    return ev.nest_events(fx.particles(spark, sf, in_order=True)).sortWithinPartitions("event_id")


def _verbose_events(spark, sf):
    return ev.nest_events(ev.with_polar(fx.particles(spark, sf)), VERBOSE_FIELDS)


def _steps(df, names, scale=1e5):
    """Decimals of a text format as whole numbers."""
    return df.withColumns({n: F.round(F.col(n) * scale).cast("long") for n in names})


def src_event_text(spark, sf):
    path = scratch_path(spark, "events")
    text.write_events(_events(spark, sf), path)
    return _steps(ev.explode_events(text.read_events(spark, path)), ["e", "px", "py", "pz"])


def src_verbose_text(spark, sf):
    path = scratch_path(spark, "verbose")
    text.write_events(_verbose_events(spark, sf), path, VERBOSE_FIELDS)
    return _steps(ev.explode_events(text.read_verbose_events(spark, path)), VERBOSE_FIELDS[1:])


def src_event_bin(spark, sf):
    path = scratch_path(spark, "dense")
    binary.write_dense_events(_events(spark, sf), path)
    return rounded(ev.explode_events(binary.read_dense_events(spark, path)), ["e", "px", "py", "pz"])


def src_token_bin(spark, sf):
    length = tk._longest(spark, sf)
    encoded = en.encode_events(_ordered_events(spark, sf), V)
    metadata = token_files.write_token_file(en.pad_sequences(encoded, length, V), scratch_path(spark, "tokens"), length, V,
                                            PerEventTokenizer.name, order=None)
    return token_files.read_token_file(spark, metadata).select("seq_id", line_of_tokens(F.col("tokens")).alias("tokens"))


def _prepared(spark, sf):
    """The packed stream as a token file, and a preparation file that splits all of it: (path, sequences)."""
    path = scratch_path(spark, "packed")
    metadata = token_files.write_token_file(en.pack_stream(en.encode_events(_events(spark, sf), V), tk.PACK, V), path, tk.PACK, V)
    total = token_files.TokenFile.read(metadata).num_full_sequences
    test = total // 10
    token_files.write_preparation(f"{path}-preparation.json", metadata, {
        "train": sq.Split(total - 2 * test), "validation": sq.Split(test, test, True), "test": sq.Split(test, 0, True)})
    return f"{path}-preparation.json", total


def split_range(spark, sf):
    """Train, validation and test by the names of a preparation file, read from the token file."""
    path, _ = _prepared(spark, sf)
    return token_files.read_splits(spark, path).select("split", "seq_id", F.size("tokens").cast("long").alias("n_tokens"))


def match_sampled(spark, sf):
    """The real test sequences that match the samples of three runs, by their sampling metadata."""
    path, total = _prepared(spark, sf)
    p = token_files.Preparation.read(path)
    lo, hi = p.bounds("test")
    models = fx.training_log(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    runs = models.select(
        F.col("model").alias("model_name"), F.lit("test_bin").alias("split"), F.lit(tk.PACK).cast("long").alias("sequence_length"),
        F.lit(lo * tk.PACK).cast("long").alias("split_start_token_idx"), (F.col("n") % (hi - lo) + 1).alias("num_sample_sequences"))
    folder = scratch_path(spark, "sampling")
    runs.withColumn("model", F.col("model_name")).write.partitionBy("model").json(folder)
    splits = small_table(spark, [(key, *p.bounds(name)) for name, key in token_files.SPLIT_KEYS.items()], "split string, lo bigint, hi bigint")
    windows = sq.sampled_windows(read_sampling(spark, f"{folder}/*/*.json"), splits, p.file.length)
    real = token_files.read_split(spark, path, "test")
    return sq.in_windows(real, windows).select("model", "place", "seq_id", line_of_tokens(F.col("tokens")).alias("tokens"))


def sink_token_bin(spark, sf):
    """Token stream of unpadded events and the stream of their lengths, both read back whole."""
    encoded = store(en.encode_events(_ordered_events(spark, sf), V), "encoded")
    stream, lengths = scratch_path(spark, "stream"), scratch_path(spark, "lengths")
    binary.write_records(encoded.withColumnRenamed("tokens", "values"), stream, "uint16", 0, "event_id")
    binary.write_token_lengths(en.event_token_lengths(encoded), lengths)
    tokens = binary.read_tokens(spark, stream, 1).select(
        F.lit("token").alias("what"), F.col("seq_id").alias("place"), F.get("tokens", F.lit(0)).cast("long").alias("value"))
    sizes = binary.read_tokens(spark, lengths, 1).select(
        F.lit("length").alias("what"), F.col("seq_id").alias("place"), F.get("tokens", F.lit(0)).cast("long").alias("value"))
    return tokens.unionByName(sizes)


def sink_event_bin(spark, sf):
    """The dense file record by record: values and padding zeros of every event."""
    path = scratch_path(spark, "dense")
    binary.write_dense_events(_events(spark, sf), path)
    width = binary.read_sidecar(path)["num_particles_max"] * 5
    records = binary.read_records(spark, path, "float64", width)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return records.select("record", F.size("values").cast("long").alias("n_values"), r(total, 3).alias("total"),
                          F.size(F.filter("values", lambda v: v == 0.0)).cast("long").alias("n_zeros"))


def decode_by_name(spark, sf):
    """Both forms of token file, each decoded by the tokenizer that its metadata names."""
    events, out = store(_ordered_events(spark, sf), "events"), None
    for cls, length in ((PerEventTokenizer, tk._longest(spark, sf)), (PackedTokenizer, tk.PACK)):
        by_event = cls is PerEventTokenizer  # encoding row by row keeps the order; packed sequences get one of their own
        sequences = tokenizer(cls.name, V, length).encode(binary.in_order(events, "event_id") if by_event else events)
        path = scratch_path(spark, "tokens")
        metadata = token_files.write_token_file(sequences, path, length, V, cls.name, order=None if by_event else "seq_id")
        file = token_files.TokenFile.read(metadata)
        particles, _ = tokenizer(file.tokenizer_class, V, file.length).decode(token_files.read_token_file(spark, metadata), fx.pdg(spark))
        part = particles.withColumn("form", F.lit(file.tokenizer_class))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["e", "px", "py", "pz"], 3)


def src_samples_text(spark, sf):
    path = scratch_path(spark, "samples")
    text.write_samples(tk._padded(spark, sf).withColumnRenamed("event_id", "sample_id"), path)
    return text.read_samples(spark, path).select("sample_id", line_of_tokens(F.col("tokens")).alias("tokens"))


def sink_samples_text(spark, sf):
    return tk._padded(spark, sf).select("event_id", line_of_tokens(F.col("tokens")).alias("line"))


def sink_event_text(spark, sf):
    return text.event_lines(_events(spark, sf)).withColumnRenamed("value", "line")


def sink_rejects(spark, sf):
    path = scratch_path(spark, "rejects")
    text.write_rejects(dc.rejects(dc.first_violation(tk._damaged(spark, sf), V)), path)
    return spark.read.schema("event_idx bigint, failure_reason string, event_row string").json(path)


def src_leading_csv(spark, sf):
    path = scratch_path(spark, "leading")
    p = ev.with_polar(fx.particles(spark, sf))
    lead = ev.leading_particle(p, VERBOSE_FIELDS).join(ev.multiplicity(p), "event_id").select(*LEADING_FIELDS)
    lead.write.option("sep", " ").csv(path)
    return rounded(text.read_leading(spark, path), ["e", "px", "py", "pz", "pt", "eta", "theta", "phi"])


def src_events_long(spark, sf):
    path = scratch_path(spark, "long")
    (fx.particles(spark, sf).withColumnRenamed("e", "energy").repartitionByRange("event_id", "particle_idx")
     .sortWithinPartitions("event_id", "particle_idx").drop("particle_idx").write.option("header", True).csv(path))
    return rounded(ev.explode_events(text.read_events_long(spark, path)).drop("particle_idx"), ["e", "px", "py", "pz"])


def parse_particles(spark, sf):
    lines = text.event_lines(_events(spark, sf))
    parsed = text.parse_event_lines(lines)
    return _steps(ev.explode_events(parsed), ["e", "px", "py", "pz"])


def format_particles(spark, sf):
    """Each particle as its piece of the line."""
    one = _events(spark, sf).select("event_id", F.posexplode("particles").alias("particle_idx", "p"))
    return one.select("event_id", F.col("particle_idx").cast("long").alias("particle_idx"), line_of_particles(F.array("p")).alias("text"))


QUERIES = {f.__name__: f for f in (
    src_event_text, src_verbose_text, src_event_bin, src_token_bin, sink_token_bin, sink_event_bin, src_samples_text,
    sink_samples_text, sink_event_text, sink_rejects, src_leading_csv, src_events_long, parse_particles, format_particles, split_range,
    match_sampled, decode_by_name)}

_P, _V, _E = f"with {fx.PARTICLES_CTE}", f"with {fx.VERBOSE_CTE}", f"with {fx.ENCODED_CTE}"
_DENSE_ID = "dense_rank() over (order by event_id) - 1 as event_id"
_TEXT = "pdgid || ' ' || printf('%.5f', e) || ' ' || printf('%.5f', px) || ' ' || printf('%.5f', py) || ' ' || printf('%.5f', pz) || ';'"
_LEAD = """, lead as (select * from (select *, row_number() over (partition by event_id order by e desc, particle_idx) as rn,
  count(*) over (partition by event_id) as num_particles from vb where particle_idx > 0) where rn = 1)"""


def _ints(names, scale="1e5"):
    return ", ".join(f"cast(round({n} * {scale}) as bigint) as {n}" for n in names)


def _r6(names):
    return ", ".join(f"round({n}, 6) + 0.0e0 as {n}" for n in names)


_VEC = ["e", "px", "py", "pz"]
ORACLE = {
    "src_event_text": _P + f" select {_DENSE_ID}, particle_idx, pdgid, {_ints(_VEC)} from particles",
    "src_verbose_text": _V + f" select {_DENSE_ID}, particle_idx, pdgid, {_ints(VERBOSE_FIELDS[1:])} from vb",
    "src_event_bin": _P + f" select {_DENSE_ID}, particle_idx, pdgid, {_r6(_VEC)} from particles",
    "src_token_bin": _E + tk._PAD + " select row_number() over (order by event_id) - 1 as seq_id, array_to_string(tokens, ' ') as tokens from padded",
    "sink_token_bin": _E + tk._STREAM + """ select 'token' as what, pos as place, token as value from stream union all
        select 'length', row_number() over (order by event_id) - 1, len(tokens) from etok""",
    "split_range": _E + tk._PACKED + """, n as (select count(*) as t, count(*) // 10 as k from packed)
        select seq_id, cast(len(tokens) as bigint) as n_tokens, case when seq_id >= (select t - k from n) then 'test'
          when seq_id >= (select t - 2 * k from n) then 'validation' else 'train' end as split from packed""",
    "match_sampled": f"with {fx.LOG_CTE}, {fx.ENCODED_CTE}" + tk._PACKED + """, n as (select count(*) as t, count(*) // 10 as k from packed),
        runs as (select model, count(*) % (select k from n) + 1 as samples from tlog group by model)
        select r.model, p.seq_id - (select t - k from n) as place, p.seq_id, array_to_string(p.tokens, ' ') as tokens
        from runs r join packed p on p.seq_id >= (select t - k from n) and p.seq_id < (select t - k from n) + r.samples""",
    "decode_by_name": _E + tk._CENTER_CTE + tk._DECODED.format(src="etok") + """, m as (select d.*, g.mass from dv d join pdg g on g.pdgid = d.pdgid)
        select form, dense_rank() over (partition by form order by event_id) - 1 as event_id, particle_idx, pdgid, round(sqrt(mass * mass + pow(pt * cosh(eta), 2)), 3) as e,
          round(pt * cos(phi), 3) + 0.0e0 as px, round(pt * sin(phi), 3) + 0.0e0 as py, round(pt * sinh(eta), 3) + 0.0e0 as pz
        from m, (values ('EventPerSequenceParticleFeatureTokenizer'), ('PackedEventStreamParticleFeatureTokenizer')) f(form)""",
    "sink_event_bin": _P + """, mx as (select max(c) as m from (select count(*) as c from particles group by event_id)),
        g as (select event_id, count(*) as c, sum(pdgid + e + px + py + pz) as total,
          sum((case when px = 0 then 1 else 0 end) + (case when py = 0 then 1 else 0 end) + (case when pz = 0 then 1 else 0 end) + (case when e = 0 then 1 else 0 end)) as z
          from particles group by event_id)
        select row_number() over (order by event_id) - 1 as record, cast(m * 5 as bigint) as n_values, round(total, 3) + 0.0e0 as total,
          cast((m - c) * 5 + z as bigint) as n_zeros from g, mx""",
    "src_samples_text": _E + tk._PAD + " select row_number() over (order by event_id) - 1 as sample_id, array_to_string(tokens, ' ') as tokens from padded",
    "sink_samples_text": _E + tk._PAD + " select event_id, array_to_string(tokens, ' ') as line from padded",
    "sink_event_text": _P + f" select event_id, string_agg({_TEXT}, '' order by particle_idx) as line from particles group by event_id",
    "sink_rejects": _E + tk._DAMAGED + f""" select event_id as event_idx, case when {tk._BADLEN} then {tk._LENGTH_REASON}
          when event_id % 7 = 2 then {tk._RANGE_REASON} else {tk._RESERVED_REASON} end as failure_reason, array_to_string(tokens, ' ') as event_row
        from damaged where event_id % 7 in (1, 2, 3)""",
    "src_leading_csv": _V + _LEAD + f" select num_particles, pdgid, {_r6(VERBOSE_FIELDS[1:])} from lead",
    "src_events_long": _P + f" select event_id, pdgid, {_r6(_VEC)} from particles",
    "parse_particles": _P + f" select event_id, particle_idx, pdgid, {_ints(_VEC)} from particles",
    "format_particles": _P + f" select event_id, particle_idx, {_TEXT} as text from particles",
}
