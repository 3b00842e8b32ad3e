"""Token files that describe themselves: type, byte order, length and totals come from the JSON beside the tokens.

The metadata is read and checked against the size of the data when the plan is made, without a job. A
range of sequences is a range of bytes, so conditions on ``seq_id`` are pushed into the source, and so are
conditions on ``split`` where a preparation file names the ranges for training, validation and test.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan,
                                    LessThanOrEqual)

from eventspark.operators.sequences import Split
from eventspark.operators.tokenizers import PackedTokenizer
from eventspark.operators.vocabulary import Vocabulary
from eventspark.sources import binary
from eventspark.sources.binary import FixedRecordReader, RecordRange

FORMAT = "tokenfile"

# The names that the metadata and preparation files use.
SPLIT_KEYS = {"train": "train_bin", "validation": "validation_bin", "test": "test_bin"}


def _read_json(path: str) -> dict:
    filesystem, target = binary._filesystem(path)
    with filesystem.open_input_stream(target) as f:
        return json.loads(f.read())


def _write_json(path: str, values: dict) -> None:
    filesystem, target = binary._filesystem(path)
    with filesystem.open_output_stream(target) as out:
        out.write(json.dumps(values, indent=4).encode())


def _below(root: str | None, path: str) -> str:
    """A path of a metadata file; relative ones begin at ``root`` where one is given."""
    return path if not root or path.startswith("/") or "://" in path else f"{root.rstrip('/')}/{path}"


@dataclass(frozen=True)
class TokenFile:
    """What the metadata of a token file states, checked against itself and the file's size."""

    path: str
    dtype: str  # with byte order
    length: int
    vocab_size: int
    total_sequences: int
    total_tokens: int
    num_full_sequences: int
    tokenizer_class: str
    schema: tuple[str, ...]

    @classmethod
    def read(cls, metadata_path: str, root: str | None = None, growing: bool = False) -> TokenFile:
        """``growing``: the file is still being written, so totals are not compared."""
        m = _read_json(metadata_path)
        kind = np.dtype(m["tokenized_dtype"]).newbyteorder({"big": ">", "little": "<"}[m.get("byte_order", "little")])
        if not np.issubdtype(kind, np.integer):
            raise TypeError(f"{metadata_path}: {kind.name} is no integer type")
        out = cls(_below(root, str(m["output_data_filepath"])), kind.str, int(m["sequence_length"]), int(m["vocab_size"]), int(m["total_sequences"]),
                  int(m["total_tokens"]), int(m["num_full_sequences"]), str(m["tokenizer_class"]), tuple(m.get("tokenization_schema", ())))
        out._check(metadata_path, growing)
        return out

    def _check(self, where: str, growing: bool) -> None:
        if self.vocab_size <= 0 or self.length <= 0 or min(self.total_sequences, self.total_tokens, self.num_full_sequences) < 0:
            raise ValueError(f"{where}: sizes have to be positive")
        size = np.dtype(self.dtype).itemsize
        if self.vocab_size > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"{where}: a vocabulary of {self.vocab_size} does not fit {np.dtype(self.dtype).name}")
        if growing:
            return
        found = sum(n for _, n in binary._part_files(self.path))
        if found % size:
            raise ValueError(f"{self.path}: {found} bytes are no whole tokens of {size} bytes")
        tokens = found // size
        if tokens != self.total_tokens:
            raise ValueError(f"{self.path} holds {tokens} tokens, its metadata states {self.total_tokens}")
        if tokens % self.length:
            raise ValueError(f"{self.path}: {tokens} tokens are no whole sequences of {self.length}")
        if tokens // self.length != self.num_full_sequences:
            raise ValueError(f"{self.path} holds {tokens // self.length} sequences, its metadata states {self.num_full_sequences}")

    @property
    def value_type(self) -> str:
        kind = np.dtype(self.dtype)
        return "int" if kind.itemsize < 4 or kind == np.dtype("i4").newbyteorder(kind.byteorder) else "bigint"


@dataclass(frozen=True)
class Preparation:
    """A token file and the ranges of it that its preparation file names."""

    file: TokenFile
    splits: dict[str, Split]

    @classmethod
    def read(cls, path: str, root: str | None = None) -> Preparation:
        p = _read_json(path)
        file = TokenFile.read(_below(root, str(p["tokenized_metadata_file"])), root)
        splits = {}
        for name, key in SPLIT_KEYS.items():
            if key in p:
                if not isinstance(p[key]["from_end"], bool):
                    raise ValueError(f"{path}: from_end of {key} has to be true or false")
                splits[name] = Split(int(p[key]["num_sequences"]), int(p[key]["skip_sequences"]), p[key]["from_end"])
                splits[name].bounds(file.num_full_sequences)  # an error where it does not fit
        return cls(file, splits)

    def bounds(self, split: str) -> tuple[int, int]:
        """First sequence and the one behind the last; ``split`` by its name or its key."""
        name = next((n for n, key in SPLIT_KEYS.items() if split in (n, key)), None)
        if name not in self.splits:
            raise ValueError(f"no split {split!r} in the preparation")
        return self.splits[name].bounds(self.file.num_full_sequences)


@dataclass
class SplitRange(RecordRange):
    split: str | None = None


class TokenFileSource(DataSource):
    """Options: ``path`` of a metadata file, or ``preparation``; ``root`` for relative paths, ``splitbytes``.

    With a preparation there is a row for each sequence and split that holds it, and a column ``split``.
    """

    @classmethod
    def name(cls):
        return FORMAT

    def _prepared(self) -> tuple[TokenFile, list[tuple[str | None, int, int]]]:
        root = self.options.get("root")
        if "preparation" in self.options:
            p = Preparation.read(self.options["preparation"], root)
            return p.file, [(name, *p.bounds(name)) for name in p.splits]
        file = TokenFile.read(self.options["path"], root, self._growing())
        return file, [(None, 0, file.num_full_sequences)]

    def _growing(self) -> bool:
        return str(self.options.get("growing", "false")).lower() == "true"

    def schema(self):
        file, ranges = self._prepared()
        split = "" if "preparation" not in self.options else "split string, "
        return f"{split}seq_id bigint, tokens array<{file.value_type}>"

    def reader(self, schema):
        return TokenFileReader(*self._prepared(), "preparation" in self.options, int(self.options.get("splitbytes", binary._SPLIT_BYTES)))


    def streamReader(self, schema):
        if "preparation" in self.options:
            raise ValueError("a growing file has no splits")
        return TokenStreamReader(TokenFile.read(self.options["path"], self.options.get("root"), True), int(self.options.get("splitbytes", binary._SPLIT_BYTES)))


class TokenStreamReader(DataSourceStreamReader):
    """Offsets are numbers of records: what a folder holds in whole records is there to be read."""

    def __init__(self, file: TokenFile, split_bytes: int):
        self.file, self.split_bytes = file, split_bytes

    def initialOffset(self) -> dict:
        return {"record": 0}

    def latestOffset(self) -> dict:
        size = np.dtype(self.file.dtype).itemsize * self.file.length
        try:
            parts = binary._part_files(self.file.path)
        except FileNotFoundError:
            parts = []
        total = 0
        for k, (path, n) in enumerate(parts):
            if n % size and k < len(parts) - 1:
                raise ValueError(f"{path}: only the last part may end in the middle of a record")
            total += n // size
        return {"record": total}

    def partitions(self, start: dict, end: dict) -> list[RecordRange]:
        size = np.dtype(self.file.dtype).itemsize * self.file.length
        step, before, out = max(1, self.split_bytes // size), 0, []
        for path, length in binary._part_files(self.file.path) if end["record"] > start["record"] else ():
            n = length // size
            first, last = max(start["record"] - before, 0), min(end["record"] - before, n)
            out += [RecordRange(path, before + skip, skip, min(step, last - skip)) for skip in range(first, last, step)]
            before += n
        return out or [RecordRange("", 0, 0, 0)]

    def read(self, partition):
        reader = FixedRecordReader({"path": self.file.path, "width": self.file.length, "dtype": self.file.dtype})
        for batch in reader.read(partition):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["seq_id", "tokens"])

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the file stays."""


class TokenFileReader(DataSourceReader):
    def __init__(self, file: TokenFile, ranges: list[tuple[str | None, int, int]], named: bool, split_bytes: int):
        self.file, self.ranges, self.named, self.split_bytes = file, ranges, named, split_bytes

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of ``seq_id`` and names of splits cut what is read; Spark evaluates what is handed back."""
        for f in filters:
            if not self._pushed(f):
                yield f

    def _pushed(self, f: Filter) -> bool:
        column = f.attribute if hasattr(f, "attribute") else ()
        if column == ("seq_id",):
            if isinstance(f, IsNotNull):
                return True
            value = getattr(f, "value", None)
            if not isinstance(value, int):
                return False
            if isinstance(f, (EqualTo, EqualNullSafe)):
                lo, hi = value, value + 1
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                lo, hi = value + isinstance(f, GreaterThan), None
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                lo, hi = None, value + isinstance(f, LessThanOrEqual)
            else:
                return False
            self.ranges = [(name, a if lo is None else max(a, lo), b if hi is None else min(b, hi)) for name, a, b in self.ranges]
            return True
        if column == ("split",) and self.named:
            if isinstance(f, IsNotNull):
                return True
            if isinstance(f, (EqualTo, EqualNullSafe, In)):
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.ranges = [r for r in self.ranges if r[0] in wanted]
                return True
        return False

    def _records(self, lo: int, hi: int) -> FixedRecordReader:
        return FixedRecordReader({"path": self.file.path, "width": self.file.length, "dtype": self.file.dtype, "lo": lo, "hi": hi,
                                  "splitbytes": self.split_bytes})

    def partitions(self):
        parts = [SplitRange(r.path, r.first_record, r.skip, r.count, name)
                 for name, lo, hi in self.ranges if lo < hi for r in self._records(lo, hi).partitions() if r.count]
        return parts or [SplitRange("", 0, 0, 0)]

    def read(self, partition):
        for batch in self._records(0, 0).read(partition):
            columns, names = [batch.column(0), batch.column(1)], ["seq_id", "tokens"]
            if self.named:
                columns.insert(0, pa.array([partition.split] * batch.num_rows, pa.string()))
                names.insert(0, "split")
            yield pa.RecordBatch.from_arrays(columns, names)


def register(spark: SparkSession) -> None:
    """Make the format known; the classes travel with the job. Conditions reach the source only if the session lets them."""
    import eventspark.sources.token_files as here

    for module in (binary, here):
        cloudpickle.register_pickle_by_value(module)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenFileSource)


def write_token_file(sequences: DataFrame, path: str, length: int, vocab: Vocabulary, tokenizer_class: str = PackedTokenizer.name,
                     dtype: str = "uint16", n_events: int | None = None, order: str | None = "seq_id", overwrite: bool = False) -> str:
    """Sequences of one length with their metadata, whose path is returned. Totals come from the written bytes."""
    if vocab.size > np.iinfo(dtype).max + 1:
        raise ValueError(f"a vocabulary of {vocab.size} does not fit {dtype}")
    binary.write_records(sequences.withColumnRenamed("tokens", "values"), path, dtype, length, order, overwrite)
    tokens = sum(n for _, n in binary._part_files(path)) // np.dtype(dtype).itemsize
    whole = tokens // length
    metadata = {
        "tokenizer_class": tokenizer_class, "tokenization_schema": list(vocab.schema), "tokenized_dtype": dtype, "byte_order": "little",
        "vocab_size": vocab.size, "sequence_length": length, "total_sequences": whole, "total_events": whole if n_events is None else n_events,
        "total_tokens": tokens, "num_full_sequences": whole, "remainder_tokens": tokens % length, "output_data_filepath": path}
    _write_json(binary._sidecar_path(path), metadata)
    return binary._sidecar_path(path)


def write_preparation(path: str, metadata_path: str, splits: dict[str, Split]) -> None:
    """A preparation file with named splits."""
    named = {SPLIT_KEYS[name]: {"num_sequences": s.num_sequences, "skip_sequences": s.skip_sequences, "from_end": s.from_end} for name, s in splits.items()}
    _write_json(path, {"tokenized_metadata_file": metadata_path, **named})


def read_token_file(spark: SparkSession, metadata_path: str, root: str | None = None) -> DataFrame:
    """(seq_id, tokens) of a token file; conditions on ``seq_id`` read only the bytes they need."""
    register(spark)
    reader = spark.read.format(FORMAT).option("path", metadata_path)
    return (reader.option("root", root) if root else reader).load()


def read_splits(spark: SparkSession, preparation_path: str, root: str | None = None) -> DataFrame:
    """(split, seq_id, tokens) for the splits that a preparation file names; conditions on both are pushed down."""
    register(spark)
    reader = spark.read.format(FORMAT).option("preparation", preparation_path)
    return (reader.option("root", root) if root else reader).load()


def read_split(spark: SparkSession, preparation_path: str, split: str, root: str | None = None) -> DataFrame:
    """(seq_id, tokens) of one split, by name or key."""
    Preparation.read(preparation_path, root).bounds(split)  # an unknown name is an error, not an empty table
    name = next(n for n, key in SPLIT_KEYS.items() if split in (n, key))
    return read_splits(spark, preparation_path, root).filter(f"split = '{name}'").drop("split")
