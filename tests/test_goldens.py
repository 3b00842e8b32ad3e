import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventspark.functions import binning as bn
from eventspark.functions import kinematics as kin
from eventspark.operators import decoding as dc
from eventspark.operators import encoding as en
from eventspark.operators import events as ev
from eventspark.operators import histograms as hs
from eventspark.operators import sequences as sq
from eventspark.operators import vocabulary as vc
from eventspark.operators.joins import join_summary
from eventspark.operators.quantiles import exact_quantiles, quantile_bins
from eventspark.plans import fixtures as fx
from eventspark.sources.text import parse_event_lines

V = fx.VOCAB
PARTICLES = "event_id bigint, particle_idx bigint, pdgid bigint, e double, px double, py double, pz double"


def particles(spark, *events):
    rows = [(i, k, int(p[0]), *map(float, p[1:])) for i, event in enumerate(events) for k, p in enumerate(event)]
    return spark.createDataFrame(rows, PARTICLES)


def values(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, v double")


def one_bin(spark, xs, bins):
    return [r.b for r in bn.bucketize(values(spark, xs), "v", bins, "b").orderBy("i").collect()]


def test_bucket_edges(spark):
    bins = bn.Bins("v", (0.0, 1.0, 2.0, 3.0))
    for b in (bins, bn.step_bins("v", 0, 3, 1), bn.linear_bins("v", 0, 3, 3)):
        assert one_bin(spark, [-5, 0.5, 1, 1.5, 2, 9, math.inf, -math.inf, math.nan], b) == [0, 0, 1, 1, 2, 2, 2, 0, 2]


def test_step_bins():
    bins = bn.step_bins("v", 0.0, 1.0, 0.3)
    assert bins.count == 4 and bins.edges[-1] == 1.0 and np.allclose(bins.edges, [0, 0.3, 0.6, 0.9, 1.0])
    for bad in (lambda: bn.step_bins("v", 0, 1, 0), lambda: bn.linear_bins("v", 1, 1, 3), lambda: bn.Bins("v", (0.0, 0.0))):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("bins", [bn.linear_bins("v", -4.0, 4.01, 801), bn.step_bins("v", -3.15, 3.15, 0.1),
                                  bn.gaussian_bins("v", -4.0, 4.0, 64, 0.5, 1.3)])
def test_bins_equal_binary_search_on_edges_and_beside_them(spark, bins):
    edges = np.array(bins.edges)
    xs = np.concatenate([edges, np.nextafter(edges, -9), np.nextafter(edges, 9), np.linspace(-6, 6, 500)])
    expected = np.searchsorted(edges[1:-1], xs, side="right").tolist()
    assert one_bin(spark, xs, bins) == expected
    column = values(spark, xs).select("i", bn.Bins("v", bins.edges).index(F.col("v")).alias("b")).orderBy("i")
    assert [r.b for r in column.collect()] == expected


def test_gaussian_bins_are_dense_at_the_center():
    bins = bn.gaussian_bins("v", -10, 10, 20, 0.0, 2.0)
    widths = np.diff(bins.edges)
    assert bins.edges[0] == -10 and bins.edges[-1] == 10 and widths.argmin() in (9, 10) and widths[0] > widths[10]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(8)
    xs = np.concatenate([rng.normal(size=400).round(2), np.full(250, 0.5)])  # one value holds more than a third
    shares = [0, 0.1, 0.25, 0.5, 0.77, 1]
    assert np.allclose(exact_quantiles(values(spark, xs), "v", shares), np.quantile(xs, shares))
    assert quantile_bins(values(spark, range(101)), "v", 4).edges == (0, 25, 50, 75, 100)
    assert quantile_bins(values(spark, range(101)), "v", 4, accuracy=10_000).count == 4


def test_left_open_bins(spark):
    bins = bn.Bins("v", (0.0, 1.0, 2.0, 3.0))
    got = values(spark, [1.0, 1.1, 2.0, -1, 9]).select("i", bins.index_left_open(F.col("v")).alias("b")).orderBy("i")
    assert [r.b for r in got.collect()] == [0, 1, 1, 0, 2]
    means = {r.bin: r["mean"] for r in hs.bin_means(values(spark, [1.0, 0.5]), "v", bins).collect()}
    assert means == {0: 0.75, 1: 1.5, 2: 2.5}


def parse(spark, *lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return {r.i: r.particles for r in parse_event_lines(df, **options).collect()}


def test_lines(spark):
    got = parse(spark, "2212 1 1 0 0;", "2212 1 1 0 0", "", "  ; ", "22 1 0 0 1; -211 2 0 1 0")
    assert {i: len(p) for i, p in got.items()} == {0: 1, 4: 2} and got[4][1].pdgid == -211
    assert set(parse(spark, "2212 1 1 0 0", require_semicolon=False)) == {0}
    with pytest.raises(Exception, match="malformed"):
        parse(spark, "1 2 3 4 5 6;")


def test_polar_corners(spark):
    df = spark.createDataFrame([(0.0, 0.0, 5.0), (0.0, 0.0, 0.0), (3.0, 4.0, 0.0)], "px double, py double, pz double")
    got = df.select(*[c.alias(k) for k, c in kin.polar(F.col("px"), F.col("py"), F.col("pz")).items()]).collect()
    assert got[0].eta == math.inf and got[1].theta == 0 and got[1].eta == math.inf
    assert got[2].pt == 5 and abs(got[2].eta) < 1e-12 and got[2].theta == pytest.approx(math.pi / 2)


def at_eta(eta, pt=10.0):
    return (22, pt * math.cosh(eta), pt, 0.0, pt * math.sinh(eta))


def test_whole_event_is_dropped(spark):
    df = particles(spark, [at_eta(1), at_eta(3.999)], [at_eta(0), at_eta(4.001), at_eta(1)], [(22, 5, 0, 0, 5)],
                   [(22, math.nan, 1, 0, 0)], [at_eta(0)])
    assert {r.event_id for r in ev.valid_events(df).collect()} == {0, 4}
    assert {r.event_id for r in ev.valid_nested_events(ev.nest_events(df)).collect()} == {0, 4}


def test_leading_and_multiplicity(spark):
    df = particles(spark, [(22, 99, 1, 0, 0), (11, 5, 1, 0, 0), (211, 5, 2, 0, 0)], [(22, 1, 1, 0, 0)])
    assert [(r.event_id, r.particle_idx) for r in ev.leading_particle(df).collect()] == [(0, 1)]
    assert {r.event_id: r.num_particles for r in ev.multiplicity(df).collect()} == {0: 2, 1: 0}


def test_missing_mass_is_never_zero(spark):
    df, pdg = particles(spark, [(99, 1, 1, 0, 0)]), fx.pdg(spark)
    with pytest.raises(Exception, match="no mass"):
        ev.with_mass(df, pdg).collect()
    assert ev.with_mass(df, pdg, "reject").count() == 0


def encoded(spark, *events):
    return en.encode_events(ev.nest_events(particles(spark, *events)), V)


def test_padding(spark):
    one = encoded(spark, [at_eta(0)])
    padded = en.pad_sequences(one, 14, V).first().tokens
    assert len(one.first().tokens) == 6 and len(padded) == 14 and padded[6:] == [0] * 8
    with pytest.raises(Exception, match="cannot be padded"):
        en.pad_sequences(one, 5, V).collect()


def test_sequence_length_rules():
    assert en.sequence_length(13, V) == 54
    with pytest.raises(ValueError):
        en.sequence_length(13, V, required=50)
    limited = vc.Vocabulary(V.special, V.pdgids, V.schema, V.bins, particle_count_override=5)
    assert en.sequence_length(3, limited) == 22
    with pytest.raises(ValueError):
        en.sequence_length(6, limited)


def test_unknown_id(spark):
    event = [(99, 10, 10.0, 0, 0)]
    with pytest.raises(Exception, match="without a token"):
        encoded(spark, event).collect()
    nested = ev.nest_events(particles(spark, event, [at_eta(0)]))
    assert [r.event_id for r in en.encode_events(nested, V, "reject").collect()] == [1]
    assert [r.event_id for r in en.encode_particles(particles(spark, event, [at_eta(0)]), V, "reject").collect()] == [1]


def check(spark, *tokens):
    df = spark.createDataFrame([(i, list(t)) for i, t in enumerate(tokens)], "event_id bigint, tokens array<int>")
    return dc.first_violation(df, V)


def test_decode_reasons(spark):
    good = [1, 5, 125, 40, 80, 2]
    got = {r.event_id: r.reason for r in check(
        spark, good, [1, 5, 125, 40, 80, 99, 2], [1, 5, 40, 40, 80, 2], [1, 17, 125, 40, 80, 2], [1, 2], [1],
        [1, 17, 125, 40, 80, 5, 40, 40, 80, 2]).collect()}
    assert got[0] is None and got[4] is None
    assert "wrong number of tokens" in got[1] and got[1] == got[5]
    assert "pt tokens in [120, 144)" in got[2]
    assert "reserved" in got[3] and "reserved" in got[6]  # the first bad particle decides


def test_split_ignores_tokens_before_the_first_start(spark):
    seqs = spark.createDataFrame([(0, [9, 9, 1, 5]), (1, [125, 40, 80, 2]), (2, [0, 0, 0, 0]), (3, [1, 2, 1, 7])],
                                 "seq_id bigint, tokens array<int>")
    got = [r.tokens for r in dc.split_on_event_start(seqs, V).orderBy("event_id").collect()]
    assert got == [[1, 5, 125, 40, 80, 2], [1, 2], [1, 7]]


def test_packed_tail(spark):
    df = spark.createDataFrame([(0, list(range(1, 13))), (5, list(range(13, 24)))], "event_id bigint, tokens array<int>")
    rows = [r.tokens for r in en.pack_stream(df, 10, V).orderBy("seq_id").collect()]
    assert rows == [list(range(1, 11)), list(range(11, 21)), [21, 22, 23] + [0] * 7]


def test_packing_without_gathering_events(spark):
    rng = np.random.default_rng(11)
    events = [[at_eta(float(rng.uniform(-3, 3)), float(rng.uniform(1, 900))) for _ in range(n)] for n in (3, 1, 200, 2)]
    df = particles(spark, *events)
    long = en.pack_particles(df, 32, V).orderBy("seq_id").collect()
    nested = en.pack_stream(en.encode_events(ev.nest_events(df), V), 32, V).orderBy("seq_id").collect()
    assert long == nested


def test_summary_join_broadcast_or_shuffled(spark):
    rows, summary = spark.range(50).withColumn("g", F.col("id") % 3), spark.createDataFrame([(0, "a"), (1, "b")], "g bigint, v string")
    small = join_summary(rows, summary, ["g"])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(small.collect()) == sorted(join_summary(rows, summary, ["g"]).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert small.count() == 34


def test_grammar(spark):
    seqs = spark.createDataFrame([(0, [1, 5, 125, 40, 80, 2, 0, 0]), (1, [1, 125, 40, 80, 2, 1])], "seq_id bigint, tokens array<int>")
    got = [(r.seq_id, r.place, r.token, r.next_token) for r in dc.grammar_violations(seqs, V).collect()]
    assert sorted(got) == [(1, 0, 1, 125), (1, 4, 2, 1)]


def test_structural_slots_and_five_features(spark):
    bins = V.bins | {"e": bn.linear_bins("e", 0, 2000, 100)}
    wide = vc.Vocabulary(V.special, V.pdgids, ("particle_start", "pdgid", "e", "pt", "eta", "phi", "particle_end"), bins)
    nested = ev.nest_events(particles(spark, [at_eta(1), (211, 500, 300, 200, 50)]))
    out = en.encode_events(nested, wide)
    values_ = dc.decode_values(dc.first_violation(out, wide), wide)
    raw = dc.decode_to_raw(values_, fx.pdg(spark), wide).orderBy("particle_idx").collect()
    assert len(out.first().tokens) == 16 and raw[1].pdgid == 211 and abs(raw[1].px - 300) < 40


def test_split_bounds():
    assert sq.Split(10, 5, True).bounds(100) == (85, 95)
    with pytest.raises(ValueError):
        sq.Split(10, 95).bounds(100)


def stream_of(spark, n, length):
    return spark.createDataFrame([(i, list(range(i * length, (i + 1) * length))) for i in range(n // length)],
                                 "seq_id bigint, tokens array<int>")


def test_blocks(spark):
    seqs = stream_of(spark, 100, 20)
    assert sq.block_count(100, 10, False) == (9, 9) and sq.block_count(100, 10, True) == (10, 0)
    a = sq.next_token_pairs(sq.token_blocks(seqs, 20, 0, 100, 10, False), 10, V, False).orderBy("block").collect()
    assert len(a) == 9 and a[8].x == list(range(80, 90)) and a[8].y == list(range(81, 91))
    b = sq.next_token_pairs(sq.token_blocks(seqs, 20, 0, 100, 20, True), 20, V, True).orderBy("block").collect()
    assert len(b) == 5 and b[4].y == [*range(81, 100), 0]
    with pytest.raises(ValueError):
        sq.token_blocks(seqs, 20, 0, 100, 30, True)


def test_starters(spark):
    seqs = spark.createDataFrame([(0, [1, 5, 6, 7]), (1, [8, 2, 1, 5]), (2, [6, 1, 4, 9])], "seq_id bigint, tokens array<int>")
    got = {r.position: r.tokens for r in sq.starters(seqs, 4, 0, 5, V).collect()}
    assert got == {0: [1, 5, 6, 7, 8], 6: [1, 5, 6, 1, 4]}  # the start at 9 has only three tokens
    far = {r.position: r.tokens for r in sq.starters(seqs, 4, 0, 10, V).collect()}
    assert far == {0: [1, 5, 6, 7, 8, 2, 1, 5, 6, 1]}


def test_histogram_and_ratio(spark):
    df = spark.createDataFrame([(x, "ref") for x in (0.0, 1.0, 2.0, 2.5)] + [(x, "gen") for x in (0.2, 0.3, 1.0)], "value double, sample string")
    counts = hs.histogram(df, bn.linear_bins("value", 0, 2, 2), ["ref", "gen"])
    assert {(r.bin, r["sample"]): r.n for r in counts.collect()} == {(0, "ref"): 1, (1, "ref"): 2, (0, "gen"): 2, (1, "gen"): 1}
    empty = spark.createDataFrame([(0, "ref", 0), (0, "gen", 3), (1, "ref", 4), (1, "gen", 0)], "bin int, sample string, n bigint")
    got = {r.bin: (r.ratio, r.ratio_err) for r in hs.ratio(empty, ["bin"], "ref").collect()}
    assert got[0] == (None, None) and got[1] == (0.0, None)


def test_category_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "c int, sample string")
    assert {r.c: (r.a, r.b) for r in hs.category_counts(df, "c", ["a", "b"]).collect()} == {1: (2, 0), 2: (0, 1)}


def test_extend_vocabulary_errors(spark):
    full = vc.Vocabulary(V.special, (22, 0), V.schema, V.bins)
    two_new = particles(spark, [(22, 1, 1, 0, 0), (7, 1, 1, 0, 0)], [(8, 1, 1, 0, 0)])
    with pytest.raises(Exception, match="free slots"):
        vc.extend_pdgids(two_new, full).collect()
    with pytest.raises(Exception, match="reserved"):
        vc.extend_pdgids(particles(spark, [(0, 1, 1, 0, 0)]), full).collect()
    one_new = particles(spark, [(22, 1, 1, 0, 0), (7, 1, 1, 0, 0)])
    assert {r.slot: r.pdgid for r in vc.extend_pdgids(one_new, full).collect()} == {0: 22, 1: 7}


def test_vocabulary_from_configuration():
    v = vc.Vocabulary.from_json("""{"special_tokens": {"padding": 0, "event_start": 1, "event_end": 2},
      "pdgids": {"0": 22, "1": 0}, "materials_named": {"C": 0}, "tokenization": {"0": "pdgid", "1": "e"}, "padding": {"0": "padding"},
      "e_bin_data": {"min": 0, "max": 10, "step_size": 5, "tokenization": "linear"},
      "phi_bin_data": {"min": -3, "max": 3, "n_bins": 4, "tokenization": "gaussian", "gaussian_center": 0, "gaussian_sigma": 1}}""")
    assert v.offsets["pdgid"] == 3 and v.offsets["material"] == 5 and v.slot_range("e") == (6, 8) and v.size == 12
    assert len(v.rows()) == 12 and [r[0] for r in v.rows()] == list(range(12))
    with pytest.raises(ValueError):
        vc.Vocabulary(V.special, (22, 22), V.schema, V.bins)


def test_token_type_strict_and_lenient(spark):
    df = spark.createDataFrame([(0,), (3,), (5,), (25,), (143,), (144,)], "t int")
    lenient = [r[0] for r in df.select(vc.token_type(F.col("t"), V, strict=False)).collect()]
    assert lenient == ["padding", "special", "pdgid", "eta", "pt", "padding"]
    with pytest.raises(Exception, match="outside the vocabulary"):
        df.select(vc.token_type(F.col("t"), V)).collect()


def test_constant_feature_scales_to_zero(spark):
    v = vc.Vocabulary(V.special, (22,), ("pdgid", "e"), {"e": bn.linear_bins("e", 0, 1, 1)})
    df = spark.createDataFrame([(6,), (1,)], "token int")
    got = {r.token: (r.scaled, r.mask) for r in vc.token_features(df, v).collect()}
    assert got == {6: (0.0, 1), 1: (0.0, 0)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from([p[0] for p in fx.PDG]), st.floats(1, 1190), st.floats(-3.9, 3.9), st.floats(-3.1, 3.1)),
                         min_size=1, max_size=6), min_size=1, max_size=12))
def test_round_trip_is_within_half_a_bin(spark, events):
    def raw(p):
        pid, pt, eta, phi = p
        return (pid, pt * math.cosh(eta), pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(eta))

    df = particles(spark, *[[raw(p) for p in e] for e in events])
    out = en.encode_events(ev.nest_events(df), V)
    packed = en.pack_stream(out, 16, V)
    again = dc.split_on_event_start(packed, V)
    assert sorted(r.tokens for r in again.collect()) == sorted(r.tokens for r in out.collect())
    decoded = dc.decode_values(dc.first_violation(out, V), V)
    errors = dc.roundtrip_error(ev.with_encoder_variables(df), decoded).collect()
    assert len(errors) == sum(map(len, events))
    for e in errors:
        assert abs(e.pt_error) <= 25 + 1e-6 and abs(e.eta_error) <= 0.0801 + 1e-9 and abs(e.phi_error) <= 0.063 + 1e-9


def test_tokens_outside_the_vocabulary_are_errors(spark):
    from eventspark.operators import vocabulary as vc

    good = spark.createDataFrame([(0,), (5,), (V.size - 1,)], "token int")
    assert vc.token_features(good, V).count() == vc.token_centers(good, V).count() == 3
    for bad in (V.size, -1, None):
        stream = good.unionByName(spark.createDataFrame([(bad,)], "token int"))
        for use in (vc.token_features, vc.token_centers, vc.vocabulary_coverage):
            with pytest.raises(Exception, match="outside the vocabulary"):
                use(stream, V).collect()


def test_dictionary_with_a_gap_is_refused():
    import json

    config = {"special_tokens": {"padding": 0}, "pdgids": {"0": 22, "1": 11, "3": 211}, "tokenization": {"0": "pdgid"}, "padding": {"0": "padding"}}
    with pytest.raises(ValueError, match="without gaps"):
        type(V).from_json(json.dumps(config))


def test_a_checkpoint_without_loss_never_wins(spark):
    from eventspark.operators.training_runs import best_checkpoint

    rows = [("a", 1, 0.5, None), ("a", 2, 0.4, float("nan")), ("a", 3, 0.3, 0.9), ("a", 4, 0.3, 0.8)]
    best = best_checkpoint(spark.createDataFrame(rows, "model string, iter bigint, train_loss double, val_loss double"))
    assert [r.iter for r in best.collect()] == [4]


def test_dictionary_round_trip_after_new_ids(spark):
    import json

    config = {"special_tokens": {"padding": 0, "event_start": 1, "event_end": 2}, "pdgids": {"0": 22, "1": 0, "2": 0},
              "tokenization": {"0": "pdgid", "1": "pt"}, "padding": {"0": "padding"},
              "pt_bin_data": {"min": 0, "max": 10, "step_size": 1}}
    vocab = type(V).from_json(json.dumps(config))
    seen = particles(spark, [(22, 5, 3, 2, 1), (211, 500, 300, 200, 50)])
    wider = vocab.with_slots(vc.extend_pdgids(seen, vocab))
    again = type(V).from_json(wider.to_json())
    assert again == wider and again.pdgids == (22, 211, 0) and again.bins == vocab.bins
