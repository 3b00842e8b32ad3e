"""Queries on the vocabulary, token sequences, decoding and slicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventspark.functions.binning import bucketize, linear_bins
from eventspark.functions.text import line_of_tokens
from eventspark.operators import decoding as dc
from eventspark.operators import encoding as en
from eventspark.operators import events as ev
from eventspark.operators import sequences as sq
from eventspark.operators import vocabulary as vc
from eventspark.operators.quantiles import quantile_bins
from eventspark.operators.vocabulary import Vocabulary
from eventspark.plans import fixtures as fx
from eventspark.plans.particles import ID, r, rounded
from eventspark.scratch import store

V = fx.VOCAB
PACK = 64  # length of packed sequences in these queries


def _text(df, *columns):
    return df.withColumns({c: line_of_tokens(F.col(c)) for c in columns})


def _events(spark, sf):
    return ev.nest_events(fx.particles(spark, sf))


def _encoded(spark, sf):
    return en.encode_events(_events(spark, sf), V)


def _longest(spark, sf):
    """Sequence length of the whole table: one scan for the largest event, as in a profiling pass."""
    rows = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").count().agg(F.max("count")).first()[0]
    return en.sequence_length(rows, V)


def _padded(spark, sf):
    return en.pad_sequences(_encoded(spark, sf), _longest(spark, sf), V)


def _packed(spark, sf):
    """The packed token table, written once like the token file it stands for."""
    return store(en.pack_stream(_encoded(spark, sf), PACK, V), "packed")


# --- vocabulary ----------------------------------------------------------------

def vocab_table(spark, sf):
    """Vocabulary joined with the particles that use its id tokens, so that it grows with the data."""
    ids = fx.particles(spark, sf).groupBy("pdgid").agg(F.count(F.lit(1)).alias("n_particles"))
    out = V.table(spark).join(ids, "pdgid", "left").fillna(0, ["n_particles"])
    return out.select(F.col("token").cast("long").alias("token"), "token_type", F.col("local_idx").cast("long").alias("local_idx"),
                      r(F.col("lo")).alias("lo"), r(F.col("hi")).alias("hi"), r(F.col("center")).alias("center"), "pdgid", "n_particles")


def token_type(spark, sf):
    stream = vc.token_stream(_padded(spark, sf))
    return stream.withColumn("token_type", vc.token_type(F.col("token"), V)).groupBy("token", "token_type").agg(
        F.count(F.lit(1)).alias("n")).withColumn("token", F.col("token").cast("long"))


def token_type_counts(spark, sf):
    return vc.token_type_counts(vc.token_stream(_padded(spark, sf)), V)


def vocab_coverage(spark, sf):
    return vc.coverage_by_type(vc.vocabulary_coverage(vc.token_stream(_encoded(spark, sf)), V))


SMALL = Vocabulary(special=V.special, pdgids=(2212, 0, 2112, 22, 0, 0, 11, 0, 0, 211, 0, 0, 0, 0),
                   schema=V.schema, bins=V.bins)


def vocab_extend(spark, sf):
    out = vc.extend_pdgids(fx.particles(spark, sf), SMALL)
    return out.select(F.col("slot").cast("long").alias("slot"), "pdgid", "is_new")


def token_features(spark, sf):
    stream = vc.token_features(vc.token_stream(_encoded(spark, sf)), V)
    return rounded(stream.groupBy("token", "scaled", "sin_phi", "cos_phi", "mask").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("token").cast("long").alias("token"), "scaled", "sin_phi", "cos_phi",
        F.col("mask").cast("long").alias("mask"), "n"), ["scaled", "sin_phi", "cos_phi"])


WIDE = linear_bins("pz", -9000.0, 9000.0, 90)
FEWER = linear_bins("pz", -6000.0, 6000.0, 60)


def decode_bin_center(spark, sf):
    """Bins of a wide range decoded by the centers of a narrower one: out-of-range numbers are clipped."""
    p = bucketize(fx.particles(spark, sf), "pz", WIDE, "bin").withColumn("bin", F.col("bin") - 15)
    return vc.decode_bin_center(p, "bin", FEWER).select(*ID, r(F.col("center")).alias("center"))


def rebin_tokens(spark, sf):
    p = fx.particles(spark, sf)
    fine = bucketize(p, "e", quantile_bins(p, "e", 40), "fine")
    return fine.select(*ID, F.col("fine").cast("long").alias("fine"), vc.rebin(F.col("fine"), 40, 10).alias("coarse"))


def whole_particle_token(spark, sf):
    p = ev.with_encoder_variables(ev.valid_events(fx.particles(spark, sf)))
    for f in ("eta", "pt", "phi"):
        p = bucketize(p, f, V.bins[f], f"{f}_bin")
    return p.select(*ID, vc.whole_particle_token(F.col("eta_bin"), F.col("pt_bin"), F.col("phi_bin"), V).alias("token"))


def join_pdgid_slot(spark, sf):
    return en.with_pdgid_slot(fx.particles(spark, sf), V).select(
        *ID, "pdgid", F.col("pdgid_token").cast("long").alias("pdgid_token"))


# --- encode ----------------------------------------------------------------------

def sequence_length(spark, sf):
    events = ev.valid_nested_events(_events(spark, sf))
    return ev.profile(events).select(
        "num_events", "num_particles_max", (F.col("num_particles_max") * len(V.schema) + 2).alias("sequence_length"))


def encode_particles(spark, sf):
    return _text(en.encode_particles(ev.valid_events(fx.particles(spark, sf)), V), "tokens")


def encode_events(spark, sf):
    return _text(_encoded(spark, sf), "tokens")


def pad_sequences(spark, sf):
    return _text(_padded(spark, sf), "tokens")


def event_token_lengths(spark, sf):
    return en.event_token_lengths(_encoded(spark, sf))


def pack_stream(spark, sf):
    return _text(_packed(spark, sf), "tokens")


def pack_particles(spark, sf):
    return _text(en.pack_particles(ev.valid_events(fx.particles(spark, sf)), PACK, V), "tokens")


def pad_jagged(spark, sf):
    flat = en.flat_values(_events(spark, sf), ("pdgid", "px", "py"))
    padded = en.pad_jagged(flat, "values", F.lit(0.0))
    return padded.select("event_id", F.array_join(F.transform(
        "values", lambda v: F.round(v).cast("long").cast("string")), " ").alias("values"))


def meta_tokenized(spark, sf):
    encoded = store(_encoded(spark, sf), "encoded")
    packed = en.pack_stream(encoded, PACK, V)
    return en.tokenized_totals(packed, encoded.count(), PACK, V)


# --- decode ----------------------------------------------------------------------

def _damaged(spark, sf):
    """Encoded events with faults that depend on the event: cut tail, wrong slot, reserved slot."""
    t = F.col("tokens")
    kind = F.col("event_id") % 7
    cut = F.slice(t, F.lit(1), F.size(t) - 1)
    wrong = F.transform(t, lambda x, i: F.when(i == 3, F.lit(130)).otherwise(x))
    reserved = F.transform(t, lambda x, i: F.when(i == 1, F.lit(18)).otherwise(x))
    return _encoded(spark, sf).withColumn(
        "tokens", F.when(kind == 1, cut).when(kind == 2, wrong).when(kind == 3, reserved).otherwise(t))


def drop_padding_tokens(spark, sf):
    return dc.drop_padding(_padded(spark, sf), V).select("event_id", F.size("tokens").cast("long").alias("n_tokens"),
                                                         line_of_tokens(F.col("tokens")).alias("tokens"))


def chk_decode_length(spark, sf):
    return dc.length_problem(_damaged(spark, sf), V).select("event_id", "bad_length")


def chk_token_range(spark, sf):
    out = dc.first_violation(_damaged(spark, sf), V, reserved=False)
    return out.filter("reason is not null").select("event_id", "reason")


def chk_reserved_pdgid(spark, sf):
    out = dc.first_violation(_damaged(spark, sf), V, in_range=False)
    return out.filter("reason like '%reserved%'").select("event_id", "reason")


def chk_grammar(spark, sf):
    bad = dc.grammar_violations(_damaged(spark, sf).withColumnRenamed("event_id", "seq_id"), V)
    return bad.select("seq_id", "place", *[F.col(c).cast("long").alias(c) for c in ("token", "next_token")])


def decode_events(spark, sf):
    values = dc.decode_values(dc.first_violation(_damaged(spark, sf), V), V)
    return rounded(values, ["pt", "eta", "phi"])


def join_token_center(spark, sf):
    """Token -> center or particle id through the vocabulary table."""
    stream = vc.token_centers(vc.token_stream(_encoded(spark, sf)), V)
    return stream.select("event_id", F.col("place").cast("long").alias("place"), F.col("token").cast("long").alias("token"),
                         r(F.col("center")).alias("center"), "pdgid")


def decode_to_raw(spark, sf):
    values = dc.decode_values(dc.first_violation(_encoded(spark, sf), V), V)
    return rounded(dc.decode_to_raw(values, fx.pdg(spark), V), ["e", "px", "py", "pz"], 3)


def meta_decoded(spark, sf):
    return dc.decoded_totals(dc.first_violation(_damaged(spark, sf), V), V)


def split_on_event_start(spark, sf):
    out = dc.split_on_event_start(_packed(spark, sf), V)
    return _text(out, "tokens")


def split_padded_sequences(spark, sf):
    out = dc.with_end_flag(dc.split_on_event_start(_padded(spark, sf), V, "event_id"), V)
    return _text(out, "tokens")


def roundtrip_error(spark, sf):
    p = ev.with_encoder_variables(ev.valid_events(fx.particles(spark, sf)))
    values = dc.decode_values(dc.first_violation(_encoded(spark, sf), V), V)
    errors = dc.roundtrip_error(p, values)
    return rounded(errors, ["pt_error", "eta_error", "phi_error"])


def trim_at_end(spark, sf):
    """Events as they are sampled: some without an end, some that go on behind it, all with padding behind."""
    more = F.when(F.col("event_id") % 2 == 0, F.array(*map(F.lit, (6, 130, 2)))).otherwise(F.array().cast("array<int>"))
    sampled = _damaged(spark, sf).withColumn("tokens", F.concat("tokens", more, F.array(*[F.lit(V.padding)] * 3)))
    return _text(dc.trim_at_end(sampled, V), "tokens")


# --- slicing -----------------------------------------------------------------------

SPLIT = sq.Split(num_sequences=200, skip_sequences=30, from_end=True)


def chk_split_overlap(spark, sf):
    """The first three quarters and the last half share the third quarter."""
    packed = _packed(spark, sf).select("seq_id")
    total = packed.count()
    return sq.split_overlap(sq.take_split(packed, sq.Split(total * 3 // 4), total),
                            sq.take_split(packed, sq.Split(total // 2, 0, True), total))


def _blocks(packed, self_contained, size):
    return sq.token_blocks(packed, PACK, 0, packed.count() * PACK, size, self_contained)


def token_blocks(spark, sf):
    return _text(_blocks(_packed(spark, sf), False, 100), "tokens")


def next_token_pairs(spark, sf):
    packed = _packed(spark, sf)
    shared = sq.next_token_pairs(_blocks(packed, False, 100), 100, V, False).withColumn("mode", F.lit("A"))
    alone = sq.next_token_pairs(_blocks(packed, True, 128), 128, V, True).withColumn("mode", F.lit("B"))
    return _text(shared.unionByName(alone), "x", "y")


def starters(spark, sf):
    return _text(sq.starters(_packed(spark, sf), PACK, 0, 5, V), "tokens")


def epoch_shuffle(spark, sf):
    # the order goes by the number of a sequence: its tokens are not written for it
    return sq.epoch_shuffle(en.pack_stream(_encoded(spark, sf), PACK, V).select("seq_id"), "seq_id", seed=1337, epoch=2)


def rank_slices(spark, sf):
    events = store(fx.particles(spark, sf).select("event_id").distinct(), "events")
    return sq.rank_slices(events, "event_id", 7)


def batch_assign(spark, sf):
    events = store(fx.particles(spark, sf).select("event_id").distinct(), "events")
    placed = sq.epoch_shuffle(events, "event_id", seed=1337, epoch=0)
    return sq.batch_assign(placed, events.count(), batch_size=16, accumulation=4, world_size=3)


def particle_index(spark, sf):
    encoded = store(_encoded(spark, sf), "encoded")
    counted = sq.particle_index(en.pack_stream(encoded, PACK, V), V, 12)
    padded = en.pad_sequences(encoded, _longest(spark, sf), V)
    place = sq.particle_index(padded, V, 8, positional=True).withColumnRenamed("event_id", "seq_id")
    both = counted.withColumn("mode", F.lit("count")).unionByName(place.withColumn("mode", F.lit("place")))
    return both.select("seq_id", "mode", line_of_tokens(F.col("particle")).alias("particle"))


def chk_token_file(spark, sf):
    packed = _packed(spark, sf)
    n = packed.count()
    stated = {"sequence_length": PACK, "total_tokens": n * PACK, "num_full_sequences": n + 1}  # last one is wrong
    return sq.token_file_checks(packed, stated, V)


QUERIES = {f.__name__: f for f in (
    vocab_table, token_type, token_type_counts, vocab_coverage, vocab_extend, token_features,
    decode_bin_center, rebin_tokens, whole_particle_token, join_pdgid_slot, sequence_length,
    encode_particles, encode_events, pad_sequences, event_token_lengths, pack_stream, pack_particles, pad_jagged,
    meta_tokenized, drop_padding_tokens, chk_decode_length, chk_token_range, chk_reserved_pdgid,
    chk_grammar, decode_events, join_token_center, decode_to_raw, meta_decoded, split_on_event_start,
    split_padded_sequences, roundtrip_error, trim_at_end, chk_split_overlap, token_blocks,
    next_token_pairs, starters, epoch_shuffle, rank_slices, batch_assign, particle_index, chk_token_file)}

# --- check SQL ---------------------------------------------------------------------

_P, _E = f"with {fx.PARTICLES_CTE}", f"with {fx.ENCODED_CTE}"


def _join(expr):
    return f"array_to_string({expr}, ' ')"


def _vocab_rows():
    rows = []
    names = ["padding", "event_start", "event_end", "particle_start", "particle_end"]
    rows += [(i, "padding" if i == 0 else "special", i, None, None, None) for i in range(len(names))]
    rows += [(5 + i, "pdgid", i, None, None, p) for i, p in enumerate([*[p[0] for p in fx.PDG], 0, 0, 0])]
    for name, offset, bins in (("eta", 20, fx.ETA_BINS), ("phi", 70, fx.PHI_BINS), ("pt", 120, fx.PT_BINS)):
        rows += [(offset + i, name, i, a, b, None) for i, (a, b) in enumerate(zip(bins.edges, bins.edges[1:]))]
    return rows


def _sql_value(v):
    if v is None:
        return "null"
    return f"'{v}'" if isinstance(v, str) else fx.number(v) if isinstance(v, float) else f"cast({v} as bigint)"


_VOCAB = ", vocab(token, token_type, local_idx, lo, hi, pdgid) as (values " + ", ".join(
    "(" + ", ".join(_sql_value(v) for v in row) + ")" for row in _vocab_rows()) + ")"
_LEN = ", seqlen as (select max(c) * 4 + 2 as l from (select count(*) as c from lineitem group by l_orderkey))"
_PAD = _LEN + """, padded as (select event_id, list_concat(tokens,
  [cast(0 as bigint) for i in range((select l from seqlen) - len(tokens))]) as tokens from etok)"""
_STREAM = """, tk as (select event_id, unnest(tokens) as token, unnest(range(len(tokens))) as place from etok),
stream as (select row_number() over (order by event_id, place) - 1 as pos, token, event_id, place from tk)"""
_PACKED = _STREAM + f""", padtail as (select pos, token from stream union all
  select n + i, 0 from (select count(*) as n from stream), unnest(range(0, {PACK})) u(i) where n + i < ((n + {PACK - 1}) // {PACK}) * {PACK}),
packed as (select pos // {PACK} as seq_id, list(token order by pos) as tokens from padtail group by 1)"""
_DAMAGED = """, damaged as (select event_id, case
   when event_id % 7 = 1 then tokens[1:len(tokens) - 1]
   when event_id % 7 = 2 then [case when i = 4 then 130 else tokens[i] end for i in range(1, len(tokens) + 1)]
   when event_id % 7 = 3 then [case when i = 2 then 18 else tokens[i] end for i in range(1, len(tokens) + 1)]
   else tokens end as tokens from etok)"""
_CENTER_CTE = _VOCAB + ", centers as (select token, 0.5e0 * (lo + hi) as center, pdgid, token_type from vocab)"
_RANGE_REASON = "'Expected valid eta tokens in [20, 70). Got something else.'"
_BADLEN = "(len(tokens) < 2 or (len(tokens) - 2) % 4 <> 0)"
_LENGTH_REASON, _RESERVED_REASON = "'Particle has the wrong number of tokens.'", "'PDGID token maps to reserved PDG slot.'"
_DECODED = """, good as (select event_id, tokens from {src}),
 dec as (select event_id, unnest(range((len(tokens) - 2) // 4)) as particle_idx, tokens from good),
 dv as (select d.event_id, d.particle_idx, c0.pdgid, c1.center as pt, c2.center as eta, c3.center as phi
   from dec d join centers c0 on c0.token = d.tokens[d.particle_idx * 4 + 2] join centers c1 on c1.token = d.tokens[d.particle_idx * 4 + 3]
   join centers c2 on c2.token = d.tokens[d.particle_idx * 4 + 4] join centers c3 on c3.token = d.tokens[d.particle_idx * 4 + 5])"""
_GOOD = "damaged where event_id % 7 not in (1, 2, 3)"
# the second slot of the event holds 130 where event_id % 7 = 2: position 4 of the list is eta

ORACLE = {
    "vocab_table": _P + _VOCAB + """ select v.token, v.token_type, v.local_idx, round(v.lo, 6) + 0.0e0 as lo, round(v.hi, 6) + 0.0e0 as hi,
        round(0.5e0 * (v.lo + v.hi), 6) + 0.0e0 as center, v.pdgid, count(p.event_id) as n_particles
        from vocab v left join particles p on p.pdgid = v.pdgid group by all""",
    "token_type": _E + _PAD + _VOCAB + """, t as (select unnest(tokens) as token from padded)
        select t.token, v.token_type, count(*) as n from t join vocab v on v.token = t.token group by all""",
    "token_type_counts": _E + _PAD + _VOCAB + """, t as (select unnest(tokens) as token from padded)
        select v.token_type, count(*) as n_tokens from t join vocab v on v.token = t.token group by all""",
    "vocab_coverage": _E + _VOCAB + """, t as (select unnest(tokens) as token from etok), n as (select token, count(*) as c from t group by token),
        j as (select v.*, coalesce(n.c, 0) as c, max(v.local_idx) over (partition by v.token_type) as top from vocab v left join n on n.token = v.token)
        select token_type, count(*) as n_entries, cast(sum(c) as bigint) as n_tokens, count(*) filter (where c = 0) as n_unused,
          count(*) filter (where token_type = 'pdgid' and pdgid = 0) as n_reserved,
          cast(coalesce(sum(c) filter (where lo is not null and local_idx in (0, top)), 0) as bigint) as n_edge from j group by token_type""",
    "vocab_extend": _P + """, slots(slot, pdgid) as (values (0, 2212), (1, 0), (2, 2112), (3, 22), (4, 0), (5, 0), (6, 11), (7, 0), (8, 0),
          (9, 211), (10, 0), (11, 0), (12, 0), (13, 0)),
        firsts as (select pdgid, row_number() over (order by e0, i0) as k from (
          select pdgid, event_id as e0, particle_idx as i0, row_number() over (partition by pdgid order by event_id, particle_idx) as rn
          from particles where pdgid not in (select pdgid from slots)) where rn = 1),
        free as (select slot, row_number() over (order by slot) as k from slots where pdgid = 0)
        select cast(s.slot as bigint) as slot, cast(coalesce(f.pdgid, s.pdgid) as bigint) as pdgid, f.pdgid is not null as is_new
        from slots s left join free on free.slot = s.slot left join firsts f on f.k = free.k""",
    "token_features": _E + _CENTER_CTE + """, t as (select unnest(tokens) as token from etok),
        span as (select token_type, min(center) as a, max(center) as b from centers where center is not null group by 1)
        select t.token, round(case when c.center is not null and c.token_type <> 'phi' then 2 * (c.center - s.a) / (s.b - s.a) - 1 else 0.0e0 end, 6) + 0.0e0 as scaled,
          round(case when c.token_type = 'phi' then sin(c.center) else 0.0e0 end, 6) + 0.0e0 as sin_phi,
          round(case when c.token_type = 'phi' then cos(c.center) else 0.0e0 end, 6) + 0.0e0 as cos_phi,
          cast(case when c.center is not null then 1 else 0 end as bigint) as mask, count(*) as n
        from t join centers c on c.token = t.token left join span s on s.token_type = c.token_type group by all""",
    "decode_bin_center": _P + f""" select event_id, particle_idx, round(-6000.0e0 + 200.0e0 * (least(greatest({fx.bin_sql('pz', WIDE)} - 15, 0), 59) + 0.5e0), 6) + 0.0e0
        as center from particles""",
    "rebin_tokens": _P + """, q as (select quantile_cont(e, [i / 40.0e0 for i in range(1, 40)]) as t from particles),
        f as (select event_id, particle_idx, cast(len(list_filter((select t from q), lambda x: x <= e)) as bigint) as fine from particles)
        select event_id, particle_idx, fine, fine // 4 as coarse from f""",
    "whole_particle_token": _E + " select event_id, particle_idx, 20 + eta_bin + 50 * pt_bin + 50 * 24 * phi_bin as token from binned",
    "join_pdgid_slot": _P + " select p.event_id, p.particle_idx, p.pdgid, cast(5 + g.slot as bigint) as pdgid_token from particles p join pdg g on g.pdgid = p.pdgid",
    "sequence_length": _E + " select count(*) as num_events, max(n_particles) as num_particles_max, max(n_particles) * 4 + 2 as sequence_length from etok",
    "encode_particles": _E + " select event_id, particle_idx, concat_ws(' ', t0, t1, t2, t3) as tokens from ptok",
    "encode_events": _E + f" select event_id, {_join('tokens')} as tokens from etok",
    "pad_sequences": _E + _PAD + f" select event_id, {_join('tokens')} as tokens from padded",
    "event_token_lengths": _E + " select event_id, cast(n_particles * 4 + 2 as bigint) as n_tokens from etok",
    "pack_stream": _E + _PACKED + f" select seq_id, {_join('tokens')} as tokens from packed",
    "pack_particles": _E + _PACKED + f" select seq_id, {_join('tokens')} as tokens from packed",
    "pad_jagged": _P + """, flat as (select event_id, flatten(list([pdgid, cast(round(px) as bigint), cast(round(py) as bigint)] order by particle_idx)) as v
          from particles group by event_id)
        select event_id, array_to_string(list_concat(v, [cast(0 as bigint) for i in range((select max(len(v)) from flat) - len(v))]), ' ') as values from flat""",
    "meta_tokenized": _E + f""", n as (select count(*) as e, sum(n_particles * 4 + 2) as t from etok),
        q as (select e, cast(((t + {PACK - 1}) // {PACK}) as bigint) as s from n)
        select e as total_events, s as total_sequences, s * {PACK} as total_tokens, s as num_full_sequences, cast(0 as bigint) as remainder_tokens,
          cast({PACK} as bigint) as sequence_length, cast(144 as bigint) as vocab_size from q""",
    "drop_padding_tokens": _E + f" select event_id, cast(len(tokens) as bigint) as n_tokens, {_join('tokens')} as tokens from etok",
    "chk_decode_length": _E + _DAMAGED + f" select event_id, {_BADLEN} as bad_length from damaged",
    "chk_token_range": _E + _DAMAGED + f""" select event_id, case when {_BADLEN} then {_LENGTH_REASON} else {_RANGE_REASON} end as reason from damaged
        where {_BADLEN} or tokens[4] < 20 or tokens[4] >= 70""",
    "chk_reserved_pdgid": _E + _DAMAGED + f" select event_id, {_RESERVED_REASON} as reason from damaged where not {_BADLEN} and tokens[2] between 17 and 19",
    "chk_grammar": _E + _DAMAGED + """, tt as (select event_id as seq_id, unnest(tokens) as token, unnest(range(len(tokens))) as place from damaged),
        kinds as (select *, case when token = 0 then 'pad' when token = 1 then 'start' when token = 2 then 'end' when token < 5 then 'free'
          when token < 20 then 'pdgid' when token < 70 then 'eta' when token < 120 then 'phi' else 'pt' end as kind from tt),
        nx as (select *, lead(token) over w as next_token, lead(kind) over w as next_kind from kinds window w as (partition by seq_id order by place)),
        legal(kind, next_kind) as (values ('start', 'pdgid'), ('pdgid', 'pt'), ('pt', 'eta'), ('eta', 'phi'), ('phi', 'pdgid'), ('phi', 'end'), ('end', 'pad'), ('pad', 'pad'))
        select seq_id, place, token, next_token from nx n where next_token is not null and kind <> 'free'
          and not exists (select 1 from legal l where l.kind = n.kind and l.next_kind = n.next_kind)""",
    "decode_events": _E + _DAMAGED + _CENTER_CTE + _DECODED.format(src=_GOOD) + """
        select event_id, particle_idx, pdgid, round(pt, 6) as pt, round(eta, 6) + 0.0e0 as eta, round(phi, 6) + 0.0e0 as phi from dv""",
    "join_token_center": _E + _CENTER_CTE + """, t as (select event_id, unnest(tokens) as token, unnest(range(len(tokens))) as place from etok)
        select t.event_id, t.place, t.token, round(c.center, 6) + 0.0e0 as center, c.pdgid from t join centers c on c.token = t.token""",
    "decode_to_raw": _E + _CENTER_CTE + _DECODED.format(src="etok") + """, m as (select d.*, g.mass from dv d join pdg g on g.pdgid = d.pdgid)
        select event_id, particle_idx, pdgid, round(sqrt(mass * mass + pow(pt * cosh(eta), 2)), 3) as e, round(pt * cos(phi), 3) + 0.0e0 as px,
          round(pt * sin(phi), 3) + 0.0e0 as py, round(pt * sinh(eta), 3) + 0.0e0 as pz from m""",
    "meta_decoded": _E + _DAMAGED + """ select count(*) filter (where event_id % 7 not in (1, 2, 3)) as total_events_written,
        cast(sum((len(tokens) - 2) // 4 * 5) filter (where event_id % 7 not in (1, 2, 3)) as bigint) as total_tokens_written,
        count(*) filter (where event_id % 7 in (1, 2, 3)) as total_invalid_events from damaged""",
    "split_on_event_start": _E + f" select row_number() over (order by event_id) - 1 as event_id, {_join('tokens')} as tokens from etok",
    "split_padded_sequences": _E + f" select row_number() over (order by event_id) - 1 as event_id, {_join('tokens')} as tokens, true as has_event_end from etok",
    "roundtrip_error": _E + _CENTER_CTE + _DECODED.format(src="etok") + """ select d.event_id, d.particle_idx, round(d.pt - v.pt, 6) + 0.0e0 as pt_error,
        round(d.eta - v.eta, 6) + 0.0e0 as eta_error, round(d.phi - v.phi, 6) + 0.0e0 as phi_error
        from dv d join valid v on v.event_id = d.event_id and v.particle_idx = d.particle_idx""",
    "trim_at_end": _E + _DAMAGED + f""", sampled as (select event_id, list_concat(list_concat(tokens, case when event_id % 2 = 0 then [6, 130, 2] else [] end),
          [0, 0, 0]) as tokens from damaged),
        stops as (select *, list_position(tokens, 2) as e, list_position(tokens, 0) as p from sampled)
        select event_id, {_join("tokens[1:least(coalesce(nullif(e, 0), len(tokens)), p - 1)]")} as tokens from stops""",
    "chk_split_overlap": _E + _PACKED + """, n as (select count(*) as t from packed)
        select seq_id from packed where seq_id < (select t * 3 // 4 from n) and seq_id >= (select t - t // 2 from n)""",
    "token_blocks": _E + _PACKED + f""", n as (select (count(*) - 1) // 100 as k from padtail),
        two as (select pos // 100 as block, pos, token from padtail union all select pos // 100 - 1, pos, token from padtail where pos % 100 = 0)
        select block, array_to_string(list(token order by pos), ' ') as tokens from two where block >= 0 and block < (select k from n) group by block""",
    "next_token_pairs": _E + _PACKED + """, n as (select count(*) as t from padtail), nx as (select pos, token, lead(token) over (order by pos) as y from padtail)
        select 'A' as mode, pos // 100 as block, array_to_string(list(token order by pos), ' ') as x, array_to_string(list(y order by pos), ' ') as y
          from nx where pos // 100 < (select (t - 1) // 100 from n) group by pos // 100
        union all select 'B', pos // 128, array_to_string(list(token order by pos), ' '),
          array_to_string(list(case when pos % 128 = 127 then 0 else y end order by pos), ' ') from nx where pos // 128 < (select t // 128 from n) group by pos // 128""",
    "starters": _E + _PACKED + """, l as (select pos, token, lead(token, 1) over w as b, lead(token, 2) over w as c, lead(token, 3) over w as d,
          lead(token, 4) over w as e from padtail window w as (order by pos))
        select pos as position, concat_ws(' ', token, b, c, d, e) as tokens from l where token = 1 and e is not null""",
    "epoch_shuffle": _E + _PACKED + " select seq_id, row_number() over (order by md5('1339:' || seq_id), seq_id) - 1 as place from packed",
    "rank_slices": _P + """, o as (select event_id, row_number() over (order by event_id) - 1 as place, count(*) over () as n from (select distinct event_id from particles)),
        w as (select unnest(range(7)) as shard)
        select event_id, place, shard from o join w on place >= n * shard // 7 and place < n * (shard + 1) // 7""",
    "batch_assign": _P + """, o as (select event_id, row_number() over (order by md5('1337:' || event_id), event_id) - 1 as place, count(*) over () as n
          from (select distinct event_id from particles)),
        a as (select event_id, place, place % 3 as replica, place // 3 // 16 as batch, place // 3 // 16 // 4 as step, n from o where place < n // 3 * 3)
        select event_id, place, replica, batch, step from a where step < n // 3 // 16 // 4""",
    "particle_index": _E + _PACKED + _PAD + """, ph as (select seq_id, pos, token >= 5 as phys, sum(case when token >= 5 then 1 else 0 end) over (partition by seq_id order by pos) as c
          from (select pos, token, pos // 64 as seq_id from padtail)),
        pl as (select event_id, unnest(tokens) as token, unnest(range(len(tokens))) as place from padded)
        select seq_id, 'count' as mode, string_agg(case when phys then least((c - 1) // 4, 11) + 1 else 0 end, ' ' order by pos) as particle from ph group by seq_id
        union all select event_id, 'place', string_agg(case when token >= 5 then least((place - 1) // 4, 7) + 1 else 0 end, ' ' order by place) from pl group by event_id""",
    "chk_token_file": _E + _PACKED + """, m as (select count(*) as t, max(token) as x from padtail)
        select 'total_tokens' as "check", t as found, t as stated, true as ok from m
        union all select 'divisible', cast(0 as bigint), cast(0 as bigint), true
        union all select 'num_full_sequences', t // 64, t // 64 + 1, false from m
        union all select 'token_below_vocab', cast(x as bigint), cast(144 as bigint), true from m
        union all select 'vocab_fits_dtype', cast(144 as bigint), cast(65536 as bigint), true""",
}
