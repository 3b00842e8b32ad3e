"""The token vocabulary: special, particle-id, material and binned-feature ranges, one after another."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspark.functions.binning import Bins, gaussian_bins, linear_bins, literal_array, step_bins
from eventspark.operators.ordering import with_position
from eventspark.schema import FEATURE_ORDER, STRUCTURAL_SLOTS, small_table
from eventspark.scratch import store

VOCAB_DDL = ("token int, token_type string, name string, feature string, local_idx int, "
             "lo double, hi double, center double, pdgid bigint")


@dataclass(frozen=True)
class Vocabulary:
    """Plan-time description of the vocabulary; ``table`` gives it as a dimension table.

    Its size is bounded by the two-byte token type of the files, so its table may always be broadcast.
    """

    special: dict[str, int]
    pdgids: tuple[int, ...]  # by slot, 0 = reserved slot
    schema: tuple[str, ...]
    bins: dict[str, Bins]
    materials: tuple[str, ...] = ()
    padding_pattern: tuple[str, ...] = ("padding",)
    particle_count_override: int | None = None
    config: dict | None = field(default=None, compare=False, repr=False)  # the dictionary it was read from
    offsets: dict[str, int] = field(init=False)

    def __post_init__(self):
        used = [p for p in self.pdgids if p != 0]
        if len(used) != len(set(used)):
            raise ValueError("a particle id has more than one slot")
        if sorted(self.special.values()) != list(range(len(self.special))):
            raise ValueError("special tokens must be numbered 0, 1, 2, ...")
        for slot in self.schema:
            if slot not in ("pdgid", *STRUCTURAL_SLOTS) and slot not in self.bins:
                raise ValueError(f"unknown or unbinned schema entry {slot!r}")
        offsets = {"special": 0, "pdgid": len(self.special)}
        offsets["material"] = offsets["pdgid"] + len(self.pdgids)
        end = offsets["material"] + len(self.materials)
        for feature in FEATURE_ORDER:
            offsets[feature] = end
            end += self.bins[feature].count if feature in self.bins else 0
        if end > 65536:
            raise ValueError(f"{end} tokens do not fit two bytes")
        offsets["end"] = end
        object.__setattr__(self, "offsets", offsets)

    @property
    def size(self) -> int:
        return self.offsets["end"]

    @property
    def padding(self) -> int:
        return self.special["padding"]

    @property
    def event_start(self) -> int:
        return self.special["event_start"]

    @property
    def event_end(self) -> int:
        return self.special["event_end"]

    @property
    def padding_tokens(self) -> list[int]:
        return [self.special[name] for name in self.padding_pattern]

    @property
    def decoded_slots(self) -> list[str]:
        return [s for s in self.schema if s not in STRUCTURAL_SLOTS]

    def slot_range(self, slot: str) -> tuple[int, int]:
        """Half-open token range of a schema entry."""
        if slot in self.special:
            return self.special[slot], self.special[slot] + 1
        if slot == "pdgid":
            return self.offsets["pdgid"], self.offsets["material"]
        return self.offsets[slot], self.offsets[slot] + self.bins[slot].count

    def ranges(self) -> list[tuple[str, int, int]]:
        """Non-empty (type, start, end) ranges in token order."""
        bounds = [("special", 0, self.offsets["pdgid"]),
                  ("pdgid", self.offsets["pdgid"], self.offsets["material"]),
                  ("material", self.offsets["material"], self.offsets["material"] + len(self.materials))]
        bounds += [(f, *self.slot_range(f)) for f in FEATURE_ORDER if f in self.bins]
        return [b for b in bounds if b[2] > b[1]]

    def rows(self) -> list[tuple]:
        out = []
        by_number = sorted(self.special.items(), key=lambda item: item[1])
        for name, token in by_number:
            kind = "padding" if name == "padding" else "special"
            out.append((token, kind, name, None, token, None, None, None, None))
        for slot, pdgid in enumerate(self.pdgids):
            name = "reserved" if pdgid == 0 else str(pdgid)
            out.append((self.offsets["pdgid"] + slot, "pdgid", name, None, slot, None, None, None, pdgid))
        for i, name in enumerate(self.materials):
            out.append((self.offsets["material"] + i, "material", name, None, i, None, None, None, None))
        for feature in FEATURE_ORDER:
            if feature in self.bins:
                bins = self.bins[feature]
                for i, (lo, hi) in enumerate(zip(bins.edges, bins.edges[1:])):
                    out.append((self.offsets[feature] + i, feature, f"{feature}_{i}", feature, i,
                                lo, hi, 0.5 * (lo + hi), None))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, self.rows(), VOCAB_DDL)

    def pdgid_slot(self, pdgid: Column) -> Column:
        """Token of a particle id, null when unknown. Works inside lambdas, where a join cannot."""
        known = [(p, slot) for slot, p in enumerate(self.pdgids) if p != 0]
        place = F.array_position(literal_array([p for p, _ in known], "bigint"), pdgid)
        slots = literal_array([s for _, s in known], "int")
        return F.when(place > 0, F.get(slots, (place - 1).cast("int")) + self.offsets["pdgid"])

    def centers_by_token(self) -> Column:
        """Constant array: bin center of every token, 0 where it has none."""
        return literal_array([row[7] if row[7] is not None else 0.0 for row in self.rows()], "double")

    def pdgids_by_token(self) -> Column:
        return literal_array([row[8] or 0 for row in self.rows()], "bigint")

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        """Build from the dictionary configuration format."""
        config = json.loads(text)
        in_order = {}
        for name in ("pdgids", "tokenization", "padding"):
            places = sorted(map(int, config[name]))
            if places != list(range(len(places))):
                raise ValueError(f"{name}: places must be 0, 1, 2, ... without gaps, not {places}")
            in_order[name] = [config[name][k] for k in sorted(config[name], key=int)]
        bins = {}
        for feature in FEATURE_ORDER:
            spec = config.get(f"{feature}_bin_data")
            if spec:
                bins[feature] = _bins_of(feature, spec)
        materials = config.get("materials_named", {})
        return cls(
            special=dict(config["special_tokens"]), pdgids=tuple(in_order["pdgids"]),
            schema=tuple(in_order["tokenization"]), bins=bins,
            materials=tuple(sorted(materials, key=materials.get)),
            padding_pattern=tuple(in_order["padding"]),
            particle_count_override=config.get("particle_count_override"), config=config)

    def to_json(self) -> str:
        """The dictionary it was read from, with the particle ids it has now."""
        if self.config is None:
            raise ValueError("this vocabulary was not read from a dictionary")
        return json.dumps(self.config | {"pdgids": {str(k): p for k, p in enumerate(self.pdgids)}}, indent=4)

    def with_slots(self, slots: DataFrame) -> Vocabulary:
        """The vocabulary with the particle ids of ``slots(slot, pdgid)``, as ``extend_pdgids`` gives them."""
        ids = list(self.pdgids)  # at most as many as two-byte tokens
        for row in slots.select("slot", "pdgid").collect():
            ids[row["slot"]] = row["pdgid"]
        return replace(self, pdgids=tuple(ids))


def _bins_of(feature: str, spec: dict) -> Bins:
    kind = spec.get("tokenization", "linear")
    lo, hi = float(spec["min"]), float(spec["max"])
    if kind == "gaussian":
        return gaussian_bins(feature, lo, hi, int(spec["n_bins"]), float(spec["gaussian_center"]),
                             float(spec.get("gaussian_sigma", 1.0)))
    if kind != "linear":
        raise ValueError(f"{feature}: binning {kind!r} is not a dictionary binning")
    if "step_size" in spec:
        return step_bins(feature, lo, hi, float(spec["step_size"]))
    return linear_bins(feature, lo, hi, int(spec["n_bins"]))


def token_stream(sequences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row for each token with its place in the sequence."""
    keep = [c for c in sequences.columns if c != tokens]
    return sequences.select(*keep, F.posexplode(tokens).alias("place", "token"))


def token_type(token: Column, vocab: Vocabulary, strict: bool = True) -> Column:
    """Type of a token by its range; outside the vocabulary an error, or padding when lenient."""
    kind = F.when(token == vocab.padding, F.lit("padding"))
    for name, lo, hi in vocab.ranges():
        kind = kind.when((token >= lo) & (token < hi), F.lit(name))
    outside = (F.raise_error(F.concat(F.lit("token outside the vocabulary: "), token.cast("string"))).cast("string")
               if strict else F.lit("padding"))
    return kind.otherwise(outside)


def token_type_counts(stream: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Tokens by type. Counted by token first, so a hot token is a few rows in the shuffle."""
    by_token = stream.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return (by_token.withColumn("token_type", token_type(F.col("token"), vocab))
            .groupBy("token_type").agg(F.sum("n").alias("n_tokens")))


def known_tokens(stream: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The stream; a token that the vocabulary lacks, or a null, is an error when it is met."""
    inside = F.coalesce((F.col("token") >= 0) & (F.col("token") < vocab.size), F.lit(False))
    message = F.concat(F.lit("token outside the vocabulary: "), F.coalesce(F.col("token").cast("string"), F.lit("null")))
    kind = stream.schema["token"].dataType
    return stream.withColumn("token", F.when(inside, F.col("token")).otherwise(F.raise_error(message).cast(kind)))


def token_centers(stream: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Attach bin center and particle id to every token, null where it has none."""
    lookup = vocab.table(stream.sparkSession).select("token", "center", "pdgid")
    return known_tokens(stream, vocab).join(F.broadcast(lookup), "token", "left")


def vocabulary_coverage(stream: DataFrame, vocab: Vocabulary) -> DataFrame:
    """For each vocabulary entry how often it occurs; unused and reserved entries keep a row."""
    table = vocab.table(stream.sparkSession)
    seen = known_tokens(stream.groupBy("token").agg(F.count(F.lit(1)).alias("n_seen")), vocab)
    last = {f: b.count - 1 for f, b in vocab.bins.items()}
    is_edge = F.lit(False)
    for feature, top in last.items():
        is_edge = is_edge | ((F.col("feature") == feature) & F.col("local_idx").isin(0, top))
    return table.join(seen, "token", "left").select(
        "token", "token_type", "name", F.coalesce("n_seen", F.lit(0)).alias("n_seen"),
        ((F.col("token_type") == "pdgid") & (F.col("pdgid") == 0)).alias("is_reserved"),
        F.coalesce(is_edge, F.lit(False)).alias("is_edge_bin"))


def coverage_by_type(coverage: DataFrame) -> DataFrame:
    """Vocabulary report by range: entries, unused and reserved ones, share of tokens in edge bins."""
    return coverage.groupBy("token_type").agg(
        F.count(F.lit(1)).alias("n_entries"), F.sum("n_seen").alias("n_tokens"),
        F.count_if(F.col("n_seen") == 0).alias("n_unused"),
        F.count_if("is_reserved").alias("n_reserved"),
        F.sum(F.when(F.col("is_edge_bin"), F.col("n_seen")).otherwise(0)).alias("n_edge"))


def extend_pdgids(particles: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Slots after giving unseen particle ids, by first appearance, the free slots.

    Distinct ids are few against particles; the groupBy shrinks the data before anything is ordered.
    """
    spark = particles.sparkSession
    first_seen = store(particles.groupBy("pdgid").agg(F.min(F.struct("event_id", "particle_idx")).alias("seen")), "first")
    checked = first_seen.withColumn("pdgid", F.when(
        F.col("pdgid") == 0, F.raise_error(F.lit("particle id 0 is reserved")).cast("bigint")
    ).otherwise(F.col("pdgid")))
    slots = small_table(spark, list(enumerate(vocab.pdgids)), "slot int, pdgid bigint")
    used, free = slots.filter("pdgid <> 0"), slots.filter("pdgid = 0").select("slot")
    unseen = with_position(
        checked.join(F.broadcast(used), "pdgid", "left_anti").select(
            "pdgid", F.col("seen.event_id").alias("event_id"), F.col("seen.particle_idx").alias("particle_idx")),
        ["event_id", "particle_idx", "pdgid"], name="k")
    free = with_position(free, ["slot"], name="k")
    n_free = sum(1 for p in vocab.pdgids if p == 0)
    placed = unseen.withColumn("k", F.when(F.col("k") < n_free, F.col("k")).otherwise(
        F.raise_error(F.lit(f"more new particle ids than the {n_free} free slots")).cast("bigint")))
    # a right join keeps every unseen id in the plan, so the check above cannot be pruned away
    added = free.join(placed, "k", "right").select("slot", "pdgid", F.lit(True).alias("is_new"))
    rest = slots.join(added.select("slot"), "slot", "left_anti")
    return rest.withColumn("is_new", F.lit(False)).unionByName(added)


def token_features(stream: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Attach scaled bin center, sin phi, cos phi and a mask to every token."""
    table = vocab.table(stream.sparkSession)
    spans = table.filter("feature is not null").groupBy("feature").agg(
        F.min("center").alias("lowest"), F.max("center").alias("highest"))
    scaled = F.when(F.col("highest") == F.col("lowest"), F.lit(0.0)).otherwise(
        2.0 * (F.col("center") - F.col("lowest")) / (F.col("highest") - F.col("lowest")) - 1.0)
    is_phi, is_bin = F.col("feature") == "phi", F.col("feature").isNotNull()
    zero = F.lit(0.0)
    lookup = table.join(F.broadcast(spans), "feature", "left").select(
        "token",
        F.when(is_bin & ~is_phi, scaled).otherwise(zero).alias("scaled"),
        F.when(is_phi, F.sin("center")).otherwise(zero).alias("sin_phi"),
        F.when(is_phi, F.cos("center")).otherwise(zero).alias("cos_phi"),
        F.when(is_bin, 1).otherwise(0).alias("mask"))
    return known_tokens(stream, vocab).join(F.broadcast(lookup), "token", "left")


def decode_bin_center(df: DataFrame, local_idx: str, bins: Bins, output: str = "center") -> DataFrame:
    """Local bin number, clipped into range, to the bin center."""
    clipped = F.least(F.greatest(F.col(local_idx), F.lit(0)), F.lit(bins.count - 1)).cast("int")
    return df.withColumn(output, F.get(literal_array(list(bins.centers), "double"), clipped))


def whole_particle_token(eta_bin: Column, pt_bin: Column, phi_bin: Column, vocab: Vocabulary) -> Column:
    """One token for a particle: the three bin numbers in mixed radix."""
    n_eta, n_pt = vocab.bins["eta"].count, vocab.bins["pt"].count
    return (vocab.offsets["eta"] + eta_bin + n_eta * pt_bin + n_eta * n_pt * phi_bin).cast("bigint")


def rebin(token: Column, fine: int, coarse: int) -> Column:
    """Number of a fine equal-frequency bin -> number of the coarse bin that contains it."""
    if fine % coarse:
        raise ValueError(f"{fine} bins do not split evenly into {coarse}")
    return F.floor(token / (fine // coarse)).cast("long")
