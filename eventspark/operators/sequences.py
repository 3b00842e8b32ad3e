"""Slicing of token sequences for training and prompting.

Sequences of one length L form a stream: token i of sequence s is at position s * L + i.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.operators.encoding import recut
from eventspark.operators.ordering import with_position
from eventspark.operators.vocabulary import Vocabulary


@dataclass(frozen=True)
class Split:
    """A contiguous range of sequences, counted from the front or from the end."""

    num_sequences: int
    skip_sequences: int = 0
    from_end: bool = False

    def bounds(self, total_sequences: int) -> tuple[int, int]:
        if self.num_sequences <= 0 or self.skip_sequences < 0:
            raise ValueError("num_sequences must be positive and skip_sequences not negative")
        if self.from_end:
            end = total_sequences - self.skip_sequences
            start = end - self.num_sequences
        else:
            start = self.skip_sequences
            end = start + self.num_sequences
        if start < 0 or end > total_sequences:
            raise ValueError(f"split [{start}, {end}) does not fit {total_sequences} sequences")
        return start, end


def take_split(sequences: DataFrame, split: Split, total_sequences: int | None = None) -> DataFrame:
    """Rows of the split; a range of the id column, which parquet and the binary source prune by."""
    total = sequences.count() if total_sequences is None else total_sequences
    start, end = split.bounds(total)
    return sequences.filter((F.col("seq_id") >= start) & (F.col("seq_id") < end))


def sampled_windows(runs: DataFrame, splits: DataFrame, sequence_length: int) -> DataFrame:
    """(model, first_sequence, end_sequence): the real sequences that the samples of each run stand for.

    ``runs`` is the sampling metadata, ``splits`` has (split, lo, hi) in sequences. More samples than the
    split has sequences, a window that does not begin with the split, another sequence length and an unknown split
    are errors: such samples cannot be compared.
    """
    known = runs.join(splits, "split", "left")
    n, at = F.col("num_sample_sequences"), F.col("split_start_token_idx")
    faults = (
        (F.col("lo").isNull(), F.lit("unknown split ")),
        (F.col("sequence_length") != sequence_length, F.lit("another sequence length in ")),
        (n > F.col("hi") - F.col("lo"), F.lit("more sequences were sampled than there are in ")),
        (at != F.col("lo") * sequence_length, F.lit("the window does not begin with ")),
        (F.floor(at / sequence_length) + n > F.col("hi"), F.lit("the window goes beyond ")))
    first = F.floor(at / sequence_length).cast("long")
    for wrong, why in reversed(faults):
        first = F.when(wrong, F.raise_error(F.concat(F.col("model"), F.lit(": "), why, F.coalesce("split", F.lit("null")))).cast("long")).otherwise(first)
    return known.select("model", first.alias("first_sequence")).join(runs.select("model", "num_sample_sequences"), "model").select(
        "model", "first_sequence", (F.col("first_sequence") + F.col("num_sample_sequences")).alias("end_sequence"))


def in_windows(sequences: DataFrame, windows: DataFrame, step: int = 65_536) -> DataFrame:
    """(model, place, seq_id, ...) for the sequences inside each window, ``place`` counted from its start.

    Windows may overlap. They and the sequences meet by an equi-join on steps of the sequence number; the
    conditions on the outermost bounds go to the source of the sequences.
    """
    bounds = windows.agg(F.min("first_sequence").alias("lo"), F.max("end_sequence").alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    cut = windows.filter("first_sequence < end_sequence").withColumn("__step", F.explode(F.sequence(
        F.floor(F.col("first_sequence") / step), F.floor((F.col("end_sequence") - 1) / step))))
    near = sequences.filter((F.col("seq_id") >= lo) & (F.col("seq_id") < hi)).withColumn("__step", F.floor(F.col("seq_id") / step))
    found = near.join(cut, "__step").filter((F.col("seq_id") >= F.col("first_sequence")) & (F.col("seq_id") < F.col("end_sequence")))
    return found.select("model", (F.col("seq_id") - F.col("first_sequence")).alias("place"), *sequences.columns)


def split_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sequences two splits share; empty when they are apart."""
    return left.join(right.select("seq_id"), "seq_id", "left_semi")


def _stream(split: DataFrame, length: int, start: int) -> DataFrame:
    return split.select(((F.col("seq_id") - start) * length).alias("at"), "tokens")


def block_count(total_tokens: int, block_size: int, self_contained: bool) -> tuple[int, int]:
    """(number of blocks, tokens dropped at the end)."""
    extra = 0 if self_contained else 1
    if total_tokens < block_size + extra:
        raise ValueError(f"{total_tokens} tokens do not make one block of {block_size}")
    blocks = (total_tokens - extra) // block_size
    return blocks, total_tokens - blocks * block_size - extra


def token_blocks(split: DataFrame, sequence_length: int, start: int, total_tokens: int, block_size: int,
                 self_contained: bool) -> DataFrame:
    """Blocks of a split: (block, tokens). With shared targets each block carries one token more.

    Self-contained blocks do not cross sequences, so the block size is a multiple of the length.
    """
    if self_contained and block_size % sequence_length:
        raise ValueError(f"block size {block_size} is not a multiple of sequence length {sequence_length}")
    blocks, _ = block_count(total_tokens, block_size, self_contained)
    stream = _stream(split, sequence_length, start)
    return recut(stream, "at", "tokens", block_size, 0 if self_contained else 1).filter(F.col("block") < blocks)


def next_token_pairs(blocks: DataFrame, block_size: int, vocab: Vocabulary, self_contained: bool) -> DataFrame:
    """Inputs x and targets y of every block; a self-contained block ends with a padding target."""
    x = F.slice("tokens", F.lit(1), F.lit(block_size))
    y = F.slice("tokens", F.lit(2), F.lit(block_size))
    if self_contained:
        y = F.concat(y, F.array(F.lit(vocab.padding)))
    return blocks.select("block", x.alias("x"), y.alias("y"))


def starters(split: DataFrame, sequence_length: int, start: int, k: int, vocab: Vocabulary) -> DataFrame:
    """First k tokens from every event start of the split: (position, tokens); short ones are dropped.

    A prompt may run into the following sequences: these lend their heads by an equi join on the id.
    """
    reach = -(-(k - 1) // sequence_length)  # following sequences a prompt can touch
    own = split.select("seq_id", "tokens")
    extended = own
    for step in range(1, reach + 1):
        need = min(sequence_length, k - 1 - (step - 1) * sequence_length)
        head = own.select((F.col("seq_id") - step).alias("seq_id"),
                          F.slice("tokens", F.lit(1), F.lit(need)).alias(f"head_{step}"))
        extended = extended.join(head, "seq_id", "left")
    heads = [F.coalesce(F.col(f"head_{s}"), F.array().cast("array<int>")) for s in range(1, reach + 1)]
    view = extended.select("seq_id", "tokens", F.concat("tokens", *heads).alias("view"))
    places = F.filter(F.transform("tokens", lambda t, i: F.when(t == vocab.event_start, i)), lambda i: i.isNotNull())
    prompts = F.transform(places, lambda i: F.struct(i.alias("i"), F.slice(F.col("view"), i + 1, F.lit(k)).alias("prompt")))
    return view.select("seq_id", F.inline(prompts)).filter(F.size("prompt") == k).select(
        ((F.col("seq_id") - start) * sequence_length + F.col("i")).alias("position"), F.col("prompt").alias("tokens"))


def shuffle_key(seed: int, epoch: int, ident: str) -> Column:
    """Sort key that depends on seed plus epoch and on the row only."""
    return F.md5(F.concat_ws(":", F.lit(seed + epoch).cast("string"), F.col(ident).cast("string")))


def epoch_shuffle(rows: DataFrame, ident: str, seed: int, epoch: int) -> DataFrame:
    """Deterministic permutation of an epoch: ``place`` of every row."""
    keyed = rows.withColumn("__key", shuffle_key(seed, epoch, ident))
    return with_position(keyed, ["__key", ident], name="place").drop("__key")


def rank_slices(rows: DataFrame, order: str, world_size: int, total: int | None = None) -> DataFrame:
    """Contiguous shard of every row: shard r holds places [n*r div w, n*(r+1) div w)."""
    n = rows.count() if total is None else total
    placed = with_position(rows, [order], name="place")
    shard = F.floor(((F.col("place") + 1) * world_size - 1) / max(n, 1))
    return placed.withColumn("shard", shard.cast("long"))


def batch_assign(placed: DataFrame, total: int, batch_size: int, accumulation: int = 1,
                 world_size: int = 1) -> DataFrame:
    """Replica, batch and optimizer step of every placed row; whatever does not fill a step is dropped."""
    per_replica = total // world_size
    batches = per_replica // batch_size
    steps = batches // accumulation
    if steps <= 0:
        raise ValueError("not enough batches for one optimizer step")
    place = F.col("place")
    local = F.floor(place / world_size).cast("long")
    batch = F.floor(local / batch_size).cast("long")
    return placed.withColumns({
        "replica": place % world_size, "batch": batch, "step": F.floor(batch / accumulation).cast("long"),
    }).filter((place < per_replica * world_size) & (F.col("step") < steps))


def particle_index(sequences: DataFrame, vocab: Vocabulary, max_particles: int, positional: bool = False) -> DataFrame:
    """Particle number (from 1) of every physics token in its sequence, 0 for special tokens.

    Counted over the physics tokens seen so far, or read off the position in the fixed event layout.
    """
    n_special, width = vocab.offsets["pdgid"], len(vocab.schema)
    if positional:
        number = lambda t, i: F.least(F.floor(F.greatest(i - 1, F.lit(0)) / width), F.lit(max_particles - 1)) + 1
        index = F.transform("tokens", lambda t, i: F.when(t >= n_special, number(t, i)).otherwise(F.lit(0)).cast("int"))
        return sequences.withColumn("particle", index)
    physics_width = len(vocab.decoded_slots)

    # a running count inside an array has no built-in form that is linear in its length; the batch is
    # counted in one pass over its flat tokens
    @F.pandas_udf("array<int>")
    def count_physics(tokens: pd.Series) -> pd.Series:
        sizes = tokens.map(len).to_numpy()
        if not sizes.sum():
            return tokens
        flat = np.concatenate(tokens.to_list())
        physics = flat >= n_special
        seen = physics.cumsum()
        ends = sizes.cumsum()
        before = np.concatenate(([0], seen))[ends - sizes]  # counts left over from earlier rows
        number = (seen - np.repeat(before, sizes) - 1) // physics_width
        number = np.where(physics, np.clip(number, 0, max_particles - 1) + 1, 0).astype(np.int32)
        return pd.Series(np.split(number, ends[:-1]))

    return sequences.withColumn("particle", count_physics("tokens"))


def token_file_checks(sequences: DataFrame, metadata: dict, vocab: Vocabulary) -> DataFrame:
    """Measured against stated totals of a token table: one row for each check."""
    length = metadata["sequence_length"]
    found = sequences.agg(
        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("tokens"), F.count(F.lit(1)).alias("sequences"),
        F.coalesce(F.max(F.array_max("tokens")), F.lit(0)).cast("long").alias("largest"))

    def check(name, value, stated, ok):
        return F.struct(F.lit(name).alias("check"), value.cast("long").alias("found"),
                        F.lit(stated).cast("long").alias("stated"), ok.alias("ok"))

    tokens, n = F.col("tokens"), F.col("sequences")
    return found.select(F.inline(F.array(
        check("total_tokens", tokens, metadata["total_tokens"], tokens == metadata["total_tokens"]),
        check("divisible", tokens % length, 0, tokens % length == 0),
        check("num_full_sequences", n, metadata["num_full_sequences"],
              (F.floor(tokens / length) == metadata["num_full_sequences"])),
        check("token_below_vocab", F.col("largest"), vocab.size, F.col("largest") < vocab.size),
        check("vocab_fits_dtype", F.lit(vocab.size), 65536, F.lit(vocab.size <= 65536)))))
