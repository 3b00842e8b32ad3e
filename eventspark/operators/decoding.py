"""Token sequences -> events, with validation and rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.functions import kinematics as kin
from eventspark.functions.binning import literal_array
from eventspark.functions.pinning import pinned
from eventspark.operators.events import with_mass
from eventspark.operators.ordering import running
from eventspark.operators.vocabulary import Vocabulary
from eventspark.schema import REASON_LENGTH, REASON_RANGE, REASON_RESERVED
from eventspark.scratch import store


def drop_padding(sequences: DataFrame, vocab: Vocabulary) -> DataFrame:
    return sequences.withColumn("tokens", F.filter("tokens", lambda t: t != vocab.padding))


def trim_at_end(samples: DataFrame, vocab: Vocabulary, stop_at_end: bool = True, stop_at_padding: bool = True) -> DataFrame:
    """Cut each sample after its first end token and before its first padding."""
    size = F.size("tokens").cast("long")
    stop = size
    if stop_at_end:
        end = F.array_position("tokens", vocab.event_end)
        stop = F.least(stop, F.when(end > 0, end).otherwise(size))
    if stop_at_padding:
        pad = F.array_position("tokens", vocab.padding)
        stop = F.least(stop, F.when(pad > 0, pad - 1).otherwise(size))
    return samples.withColumn("tokens", F.slice("tokens", F.lit(1), stop.cast("int")))


def event_pieces(sequences: DataFrame, vocab: Vocabulary, order: str = "seq_id") -> DataFrame:
    """Sequences, read as one stream without padding, cut at every start token: (event_id, order, piece).

    Events may cross sequences. Each sequence is cut by itself; a prefix sum of the start counts numbers
    the events, and the piece before the first start continues the event of an earlier sequence. Tokens
    before the very first start are dropped.
    """
    source = sequences.select(F.col(order).alias("__seq"), "tokens")
    clean = pinned(source, "tokens", F.filter("tokens", lambda t: t != vocab.padding)).filter(F.size("tokens") > 0)
    is_start = lambda t: t == vocab.event_start
    starts = F.filter(F.transform("tokens", lambda t, i: F.when(is_start(t), i)), lambda i: i.isNotNull())
    # written once: numbering the events reads ids and counts only
    cut = store(pinned(clean, "starts", starts).withColumn("n", F.size("starts").cast("long")), "cut")
    numbered = running(cut.select("__seq", "n"), ["__seq"], sums={"upto": F.col("n")}).select(
        "__seq", (F.col("upto") - F.col("n")).alias("before"))
    size = F.size("tokens")
    bounds = F.concat(F.array(F.lit(0)), F.col("starts"), F.array(size))
    # piece 0 runs up to the first start, piece j from start j to the next one
    pieces = F.transform(F.sequence(F.lit(0), F.size("starts")), lambda j: F.struct(
        j.alias("j"), F.slice(F.col("tokens"), F.get(bounds, j) + 1,
                              F.get(bounds, j + 1) - F.get(bounds, j)).alias("piece")))
    parts = cut.join(numbered, "__seq").select("__seq", "before", F.inline(pieces)).filter(F.size("piece") > 0)
    event = (F.col("before") + F.col("j") - 1).alias("event_id")
    return parts.select(event, F.col("__seq").alias("order"), "piece").filter("event_id >= 0")


def split_on_event_start(sequences: DataFrame, vocab: Vocabulary, order: str = "seq_id") -> DataFrame:
    """The pieces of every event in one row: (event_id, tokens)."""
    return (event_pieces(sequences, vocab, order).groupBy("event_id")
            .agg(F.sort_array(F.collect_list(F.struct("order", "piece"))).alias("parts"))
            .select("event_id", F.flatten(F.transform("parts", lambda p: p["piece"])).alias("tokens")))


def _inner(tokens: Column) -> Column:
    """Tokens between the first and the last one."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))


def _good_length(tokens: Column, width: int) -> Column:
    inner = F.size(tokens) - 2
    return (inner >= 0) & (inner % width == 0)


def length_problem(events: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Flag events whose inner length is not a whole number of particles."""
    return events.withColumn("bad_length", ~_good_length(F.col("tokens"), len(vocab.schema)))


def _violations(tokens: Column, vocab: Vocabulary, in_range: bool, reserved: bool) -> Column:
    """Codes of all violations, smallest first met: particle by particle, ranges before reserved slots."""
    width = len(vocab.schema)
    ranges = [vocab.slot_range(s) for s in vocab.schema]
    low = literal_array([a for a, _ in ranges], "int")
    high = literal_array([b for _, b in ranges], "int")
    ids = vocab.pdgids_by_token()
    id_slots = [i for i, s in enumerate(vocab.schema) if s == "pdgid"]

    def code(token, i):
        slot, particle = i % width, F.floor(i / width).cast("int")
        outside = (token < F.get(low, slot)) | (token >= F.get(high, slot))
        found = F.when(F.lit(in_range) & outside, particle * 2 * width + slot)
        if reserved and id_slots:
            unused = slot.isin(id_slots) & ~outside & (F.get(ids, token) == 0)
            found = found.when(unused, particle * 2 * width + width + slot)
        return found

    return F.filter(F.transform(_inner(tokens), code), lambda c: c.isNotNull())


def first_violation(events: DataFrame, vocab: Vocabulary, in_range: bool = True, reserved: bool = True) -> DataFrame:
    """Add the reason an event cannot be decoded, null for a good one."""
    width = len(vocab.schema)
    coded = pinned(events, "__code", F.array_min(_violations(F.col("tokens"), vocab, in_range, reserved)))
    code = F.col("__code")
    kind = code % (2 * width)
    reasons = literal_array_of_text([REASON_RANGE.format(slot=s, lo=vocab.slot_range(s)[0], hi=vocab.slot_range(s)[1])
                                     for s in vocab.schema])
    reason = F.when(~_good_length(F.col("tokens"), width), F.lit(REASON_LENGTH)).when(
        code.isNotNull() & (kind >= width), F.lit(REASON_RESERVED)).when(code.isNotNull(), F.get(reasons, kind))
    return coded.withColumn("reason", reason).drop("__code")


def literal_array_of_text(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def decode_values(checked: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Good events -> one row for each particle with its decoded schema values.

    Lookups go to constant arrays indexed by token, so decoding has no join and no shuffle.
    """
    width = len(vocab.schema)
    centers, ids = vocab.centers_by_token(), vocab.pdgids_by_token()
    inner = F.col("inner")

    def particle(i):
        fields = []
        for place, slot in enumerate(vocab.schema):
            if slot in vocab.decoded_slots:
                token = F.get(inner, i * width + place)
                fields.append(F.get(ids if slot == "pdgid" else centers, token).alias(slot))
        return F.struct(*fields)

    good = checked.filter("reason is null").select("event_id", _inner(F.col("tokens")).alias("inner"))
    count = F.floor(F.size("inner") / width).cast("int")
    rows = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), particle))
    return good.select("event_id", F.posexplode(rows).alias("particle_idx", "p")).select(
        "event_id", F.col("particle_idx").cast("long").alias("particle_idx"), "p.*")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.filter("reason is not null").select("event_id", "reason", "tokens")


def decode_to_raw(values: DataFrame, pdg: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Decoded values -> (pdgid, e, px, py, pz), features found by name."""
    massive = with_mass(values, pdg)
    vector = kin.four_vector(F.col("mass"), {s: F.col(s) for s in vocab.decoded_slots if s != "pdgid"})
    return massive.select("event_id", "particle_idx", "pdgid",
                          *[vector[f].alias(f) for f in ("e", "px", "py", "pz")])


def with_end_flag(events: DataFrame, vocab: Vocabulary) -> DataFrame:
    return events.withColumn("has_event_end", F.coalesce(F.try_element_at("tokens", F.lit(-1)) == vocab.event_end, F.lit(False)))


def decoded_totals(checked: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Events and values written and events rejected. A raw particle has five values."""
    good = F.col("reason").isNull()
    particles = F.floor((F.size("tokens") - 2) / len(vocab.schema))
    return checked.agg(
        F.count_if(good).alias("total_events_written"),
        F.coalesce(F.sum(F.when(good, particles * 5)), F.lit(0)).cast("long").alias("total_tokens_written"),
        F.count_if(~good).alias("total_invalid_events"))


def transition_masks(vocab: Vocabulary) -> tuple[list[int], list[int]]:
    """For every token the roles it can play and the roles its follower can have, as bit masks.

    The grammar is a graph of roles: the entries of the schema go round, the start leads in, the end leads
    out to the padding pattern, whose last token and the padding repeat. A token without an outgoing
    edge may be followed by anything.
    """
    graph: dict[str, tuple[str, ...]] = {}
    spans: dict[str, tuple[int, int]] = {}

    def role(name: str, span: tuple[int, int], *followers: str) -> None:
        graph[name], spans[name] = followers, span

    one = lambda token: (token, token + 1)
    n, pads = len(vocab.schema), vocab.padding_tokens
    role("start", one(vocab.event_start), "slot 0")
    role("end", one(vocab.event_end), "pad 0")
    role("padding", one(vocab.padding), "padding")
    for k, entry in enumerate(vocab.schema):
        role(f"slot {k}", vocab.slot_range(entry), f"slot {(k + 1) % n}", *(["end"] if k == n - 1 else []))
    for k, token in enumerate(pads):
        role(f"pad {k}", one(token), f"pad {k + 1}" if k + 1 < len(pads) else "padding")

    bit = {name: 1 << k for k, name in enumerate(graph)}
    is_a, leads_to = [0] * vocab.size, [0] * vocab.size
    for name, (lo, hi) in spans.items():
        for token in range(lo, hi):
            is_a[token] |= bit[name]
            leads_to[token] |= sum(bit[f] for f in graph[name])
    return is_a, leads_to


def grammar_violations(sequences: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Adjacent tokens the grammar forbids: (seq_id, place, token, next_token), one row for each.

    Two lookups and a bitwise and for a pair; tokens outside the vocabulary have no role.
    """
    is_a, leads_to = (literal_array(m, "bigint") for m in transition_masks(vocab))
    no_role = F.lit(0).cast("bigint")

    def pair(token, place):
        follower = F.get("tokens", place + 1)
        allowed = F.coalesce(F.get(leads_to, token), no_role)
        return F.struct(place.cast("long").alias("place"), token.alias("token"), follower.alias("next_token"),
                        ((allowed != 0) & (allowed.bitwiseAND(F.coalesce(F.get(is_a, follower), no_role)) == 0)).alias("bad"))

    pairs = F.transform(F.slice("tokens", F.lit(1), F.size("tokens") - 1), pair)
    return sequences.filter(F.size("tokens") > 1).select("seq_id", F.inline(F.filter(pairs, lambda p: p["bad"]))).drop("bad")


def roundtrip_error(original: DataFrame, decoded: DataFrame, features=("pt", "eta", "phi")) -> DataFrame:
    """Decoded minus original value of every particle; event ids have to agree."""
    left = original.select("event_id", "particle_idx", *features)
    right = decoded.select("event_id", "particle_idx", *[F.col(f).alias(f"decoded_{f}") for f in features])
    return left.join(right, ["event_id", "particle_idx"]).select(
        "event_id", "particle_idx", *[(F.col(f"decoded_{f}") - F.col(f)).alias(f"{f}_error") for f in features])
