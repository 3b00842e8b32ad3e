"""Tokenizers by the name that a token file's metadata states.

A tokenizer turns events into sequences of one length and back. Users derive from one of the classes here,
override what differs and register the class; files that name it are then read with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventspark.operators import decoding, encoding
from eventspark.operators.vocabulary import Vocabulary

_KNOWN: dict[str, type[ParticleTokenizer]] = {}


def register_tokenizer(name: str):
    """Class decorator: metadata with ``tokenizer_class`` = ``name`` are read with this class."""
    def known(cls):
        if _KNOWN.get(name, cls).__qualname__ != cls.__qualname__:
            raise ValueError(f"{name} is registered already")
        cls.name = name
        _KNOWN[name] = cls
        return cls

    return known


def tokenizer(name: str, vocab: Vocabulary, length: int) -> ParticleTokenizer:
    """The tokenizer registered under ``name``; another name is an error."""
    if name not in _KNOWN:
        raise ValueError(f"no tokenizer {name!r}; known are {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name](vocab, length)


class ParticleTokenizer:
    """Events of valid particles as tokens; the steps of ``encode`` and ``decode`` may be overridden one by one."""

    name = ""

    def __init__(self, vocab: Vocabulary, length: int):
        self.vocab, self.length = vocab, length

    # --- events to sequences

    def encode_event(self, events: DataFrame) -> DataFrame:
        """(event_id, particles) -> (event_id, tokens)."""
        return encoding.encode_events(events, self.vocab)

    def to_sequences(self, encoded: DataFrame) -> DataFrame:
        """(event_id, tokens) -> sequences of ``length`` in column ``tokens``."""
        raise NotImplementedError

    def encode(self, events: DataFrame) -> DataFrame:
        return self.to_sequences(self.encode_event(events))

    # --- sequences to particles

    def to_events(self, sequences: DataFrame) -> DataFrame:
        """(seq_id, tokens) -> (event_id, tokens) without padding."""
        raise NotImplementedError

    def check_event(self, events: DataFrame) -> DataFrame:
        """Add the reason why an event cannot be decoded, null for a good one."""
        return decoding.first_violation(events, self.vocab)

    def decode_event(self, checked: DataFrame, pdg: DataFrame) -> DataFrame:
        """Good events -> (event_id, particle_idx, pdgid, e, px, py, pz)."""
        return decoding.decode_to_raw(decoding.decode_values(checked, self.vocab), pdg, self.vocab)

    def postprocess(self, particles: DataFrame) -> DataFrame:
        """What is left to do with decoded particles."""
        return particles

    def decode(self, sequences: DataFrame, pdg: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(particles, rejected events with their reason)."""
        checked = self.check_event(self.to_events(sequences))
        return self.postprocess(self.decode_event(checked, pdg)), decoding.rejects(checked)


@register_tokenizer("EventPerSequenceParticleFeatureTokenizer")
class PerEventTokenizer(ParticleTokenizer):
    """One event a sequence, filled up with padding. Row by row, so a stream will do."""

    def to_sequences(self, encoded: DataFrame) -> DataFrame:
        return encoding.pad_sequences(encoded, self.length, self.vocab)

    def to_events(self, sequences: DataFrame) -> DataFrame:
        return decoding.trim_at_end(sequences, self.vocab).withColumnRenamed("seq_id", "event_id")


@register_tokenizer("PackedEventStreamParticleFeatureTokenizer")
class PackedTokenizer(ParticleTokenizer):
    """Events one after the other, cut into sequences; only the last one is padded. Needs the whole table."""

    def to_sequences(self, encoded: DataFrame) -> DataFrame:
        return encoding.pack_stream(encoded, self.length, self.vocab)

    def to_events(self, sequences: DataFrame) -> DataFrame:
        return decoding.split_on_event_start(sequences, self.vocab)
