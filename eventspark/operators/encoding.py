"""Events -> token sequences.

Everything about one event is one row's work, so encoding nested events shuffles nothing. Only the
packed stream needs the order of events: it takes a prefix sum of the token counts and then moves
array slices, not single tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import kinematics as kin
from eventspark.functions.pinning import pinned
from eventspark.operators.events import valid_nested_events
from eventspark.operators.ordering import running
from eventspark.operators.vocabulary import Vocabulary
from eventspark.schema import ETA_LIMIT, STRUCTURAL_SLOTS
from eventspark.scratch import store


def sequence_length(num_particles_max: int, vocab: Vocabulary, required: int | None = None) -> int:
    """Length that holds the largest event; the override and a required length are checked against it."""
    override = vocab.particle_count_override
    if override is not None:
        if override < num_particles_max:
            raise ValueError(f"particle_count_override {override} is below the largest event, {num_particles_max}")
        num_particles_max = override
    length = num_particles_max * len(vocab.schema) + 2
    if required is not None and required != length:
        raise ValueError(f"sequence length {required} given, {length} needed")
    return length


def _slot_tokens(values: dict[str, Column], pdgid_token: Column, vocab: Vocabulary) -> Column:
    tokens = []
    for slot in vocab.schema:
        if slot in STRUCTURAL_SLOTS:
            tokens.append(F.lit(vocab.special[slot]))
        elif slot == "pdgid":
            tokens.append(pdgid_token)
        else:
            tokens.append(vocab.bins[slot].index(values[slot]) + vocab.offsets[slot])
    return F.array(*[t.cast("int") for t in tokens])


def _unknown_id(pdgid: Column) -> Column:
    return F.raise_error(F.concat(F.lit("particle id without a token: "), pdgid.cast("string")))


def with_pdgid_slot(particles: DataFrame, vocab: Vocabulary, on_unknown: str = "error") -> DataFrame:
    """Token of the particle id by a join with the (bounded) vocabulary.

    ``on_unknown``: "error", or "reject" to drop the whole event.
    """
    ids = vocab.table(particles.sparkSession).filter("token_type = 'pdgid' and pdgid <> 0").select(
        "pdgid", F.col("token").alias("pdgid_token"))
    joined = particles.join(F.broadcast(ids), "pdgid", "left").select(*particles.columns, "pdgid_token")
    if on_unknown == "error":
        return joined.withColumn("pdgid_token", F.coalesce("pdgid_token", _unknown_id(F.col("pdgid")).cast("int")))
    if on_unknown != "reject":
        raise ValueError(f"unknown on_unknown {on_unknown!r}")
    lost = particles.join(F.broadcast(ids), "pdgid", "left_anti").select("event_id").distinct()
    return joined.join(lost, "event_id", "left_anti")


def encode_particles(particles: DataFrame, vocab: Vocabulary, on_unknown: str = "error") -> DataFrame:
    """Tokens of every particle in schema order, in whole-stage code; the events must be valid."""
    values = kin.encoder_variables(F.col("px"), F.col("py"), F.col("pz")) | {
        f: F.col(f) for f in ("e", "px", "py", "pz")}
    return with_pdgid_slot(particles, vocab, on_unknown).select(
        "event_id", "particle_idx", _slot_tokens(values, F.col("pdgid_token"), vocab).alias("tokens"))


def encode_events(events: DataFrame, vocab: Vocabulary, on_unknown: str = "error",
                  eta_limit: float = ETA_LIMIT) -> DataFrame:
    """Valid nested events -> tokens in place of the particles: start, particles in order, end.

    No shuffle, so it serves batch and streaming tables alike.
    """
    valid = valid_nested_events(events, eta_limit)

    def variables(p):
        polar = kin.encoder_variables(p["px"], p["py"], p["pz"])
        own = {f: p[f] for f in ("pdgid", "e", "px", "py", "pz")}
        return F.struct(*[c.alias(k) for k, c in (own | polar).items()], vocab.pdgid_slot(p["pdgid"]).alias("slot"))

    def tokens(v):
        slot = v["slot"] if on_unknown == "reject" else F.coalesce(v["slot"], _unknown_id(v["pdgid"]).cast("int"))
        return _slot_tokens({f: v[f] for f in ("e", "px", "py", "pz", "pt", "eta", "theta", "phi")}, slot, vocab)

    if on_unknown == "reject":
        valid = valid.filter(F.forall("particles", lambda p: vocab.pdgid_slot(p["pdgid"]).isNotNull()))
    elif on_unknown != "error":
        raise ValueError(f"unknown on_unknown {on_unknown!r}")
    inner = F.flatten(F.transform(F.transform("particles", variables), tokens))
    return pinned(valid, "tokens", F.concat(
        F.array(F.lit(vocab.event_start)), inner, F.array(F.lit(vocab.event_end)))).drop("particles")


def event_token_lengths(encoded: DataFrame) -> DataFrame:
    """Tokens of every event."""
    return encoded.select("event_id", F.size("tokens").cast("long").alias("n_tokens"))


def pad_sequences(encoded: DataFrame, length: int, vocab: Vocabulary) -> DataFrame:
    """Repeat the padding pattern up to the exact length; too long or not exact is an error."""
    pattern = vocab.padding_tokens
    size = F.size("tokens")
    missing = F.lit(length) - size
    problem = F.concat(size.cast("string"), F.lit(f" tokens cannot be padded to {length} by {len(pattern)}"))
    repeats = F.when((missing >= 0) & (missing % len(pattern) == 0), F.floor(missing / len(pattern)).cast("int")).otherwise(
        F.raise_error(problem).cast("int"))
    fill = F.flatten(F.array_repeat(F.array(*[F.lit(t) for t in pattern]), repeats))
    return encoded.withColumn("tokens", F.concat("tokens", fill))


def recut(pieces: DataFrame, start: str, tokens: str, length: int, overlap: int = 0) -> DataFrame:
    """Pieces of a stream -> blocks of ``length`` (+ ``overlap`` shared with the next one).

    A piece is an array at a stream position. Every block takes the slices that fall into it, so array
    slices move through one shuffle and a task never holds more than single blocks.
    """
    begin, n = F.col(start), F.size(tokens)
    first = F.greatest(F.floor((begin - overlap) / length), F.lit(0))
    last = F.floor((begin + n - 1) / length)

    def part(block):
        lo = F.greatest(block * length - begin, F.lit(0))
        hi = F.least((block + 1) * length + overlap - begin, n.cast("long"))
        return F.struct(block.alias("block"), (begin + lo).alias("at"),
                        F.slice(F.col(tokens), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    cut = pieces.filter(n > 0).select(F.inline(F.transform(F.sequence(first.cast("long"), last.cast("long")), part)))
    joined = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return joined.select("block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("tokens"))


def pack_stream(encoded: DataFrame, length: int, vocab: Vocabulary) -> DataFrame:
    """All events, one after another, cut into sequences of ``length``; only the tail is padded.

    The encoded events are written once: the prefix sum then reads nothing but ids and lengths.
    """
    if length <= 0:
        raise ValueError("the packed form needs a sequence length")
    encoded = store(encoded.select("event_id", "tokens", F.size("tokens").cast("long").alias("n_tokens")), "encoded")
    ends = running(encoded.select("event_id", "n_tokens"), ["event_id"], sums={"end": F.col("n_tokens")}).select(
        "event_id", (F.col("end") - F.col("n_tokens")).alias("start"))
    return _with_tail(recut(encoded.select("event_id", "tokens").join(ends, "event_id"), "start", "tokens", length), length, vocab)


def pack_particles(particles: DataFrame, length: int, vocab: Vocabulary, on_unknown: str = "error") -> DataFrame:
    """``pack_stream`` from valid particles in long form, without ever gathering an event.

    Each particle's tokens are a piece of the stream of their own: place of the event, plus the start
    token, plus the particles before. So an event may be larger than a task.
    """
    width = len(vocab.schema)
    pieces = store(encode_particles(particles, vocab, on_unknown), "pieces")
    sizes = store(pieces.groupBy("event_id").agg((F.count(F.lit(1)) * width + 2).alias("n_tokens")), "sizes")
    spans = store(running(sizes, ["event_id"], sums={"end": F.col("n_tokens")}).select(
        "event_id", (F.col("end") - F.col("n_tokens")).alias("start"), "end"), "spans")
    inner = pieces.join(spans, "event_id").select(
        (F.col("start") + 1 + F.col("particle_idx") * width).alias("start"), "tokens")
    frame = spans.select(F.inline(F.array(
        F.struct("start", F.array(F.lit(vocab.event_start)).alias("tokens")),
        F.struct((F.col("end") - 1).alias("start"), F.array(F.lit(vocab.event_end)).alias("tokens")))))
    return _with_tail(recut(inner.unionByName(frame), "start", "tokens", length), length, vocab)


def _with_tail(blocks: DataFrame, length: int, vocab: Vocabulary) -> DataFrame:
    return blocks.select(F.col("block").alias("seq_id"), F.concat(
        "tokens", F.array_repeat(F.lit(vocab.padding), F.lit(length) - F.size("tokens"))).alias("tokens"))


def pad_jagged(rows: DataFrame, column: str, fill: Column) -> DataFrame:
    """Pad arrays to the longest one."""
    longest = rows.agg(F.max(F.size(column))).first()[0] or 0
    return pad_to(rows, column, fill, longest)


def pad_to(rows: DataFrame, column: str, fill: Column, length: int) -> DataFrame:
    """Pad arrays to a length none of them exceeds."""
    return rows.withColumn(column, F.concat(column, F.array_repeat(fill, F.lit(length) - F.size(column))))


def flat_values(events: DataFrame, fields=("pdgid", "e", "px", "py", "pz")) -> DataFrame:
    """Particles as one flat array of doubles."""
    flat = F.flatten(F.transform("particles", lambda p: F.array(*[p[f].cast("double") for f in fields])))
    return events.select("event_id", flat.alias("values"))


def tokenized_totals(sequences: DataFrame, n_events: int, length: int, vocab: Vocabulary) -> DataFrame:
    """Totals kept beside a token file."""
    tokens = F.coalesce(F.sum(F.size("tokens")), F.lit(0))
    return sequences.agg(F.count(F.lit(1)).alias("total_sequences"), tokens.alias("total_tokens")).select(
        F.lit(n_events).cast("long").alias("total_events"), "total_sequences", "total_tokens",
        F.floor(F.col("total_tokens") / length).cast("long").alias("num_full_sequences"),
        (F.col("total_tokens") % length).alias("remainder_tokens"),
        F.lit(length).cast("long").alias("sequence_length"), F.lit(vocab.size).cast("long").alias("vocab_size"))
