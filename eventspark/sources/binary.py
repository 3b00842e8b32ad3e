"""Flat binary files of fixed-width records, as a Python data source with readers and writers.

A folder of part files, in name order, is one stream of records. Record numbers follow from file
sizes, so every row gets its global number without a job, and a range of records is pruned before
anything is read.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from eventspark.operators.encoding import flat_values, pad_to
from eventspark.schema import RAW_FIELDS
from eventspark.scratch import store

FORMAT = "fixedrecords"
_SPLIT_BYTES = 64 << 20
_BATCH_VALUES = 1 << 20
_TYPES = {"float64": ("<f8", "double"), "uint8": ("<u1", "int"), "uint16": ("<u2", "int"), "int32": ("<i4", "int"),
          "uint32": ("<u4", "bigint"), "int64": ("<i8", "bigint")}


def _filesystem(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _part_files(path: str) -> list[tuple[str, int]]:
    filesystem, root = _filesystem(path)
    info = filesystem.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    found = filesystem.get_file_info(pafs.FileSelector(root))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".bin"))


@dataclass
class RecordRange(InputPartition):
    path: str
    first_record: int  # number of the first record in the whole stream
    skip: int  # records to skip in the file
    count: int


class FixedRecordSource(DataSource):
    """Options: path, width (values a record), dtype; for reading also first and last record."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return f"record bigint, values array<{_TYPES[self.options['dtype']][1]}>"

    def reader(self, schema):
        return FixedRecordReader(self.options)

    def writer(self, schema, overwrite):
        return FixedRecordWriter(self.options)


class FixedRecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options["width"])
        self.dtype = np.dtype(_TYPES[options["dtype"]][0] if options["dtype"] in _TYPES else options["dtype"])
        self.lo = int(options.get("lo", 0))
        self.hi = int(options["hi"]) if "hi" in options else None
        self.split = int(options.get("splitbytes", _SPLIT_BYTES))

    def partitions(self):
        size = self.width * self.dtype.itemsize
        parts, before = [], 0
        step = max(1, self.split // size)
        for path, length in _part_files(self.path):
            if length % size:
                raise ValueError(f"{path}: {length} bytes are not whole records of {size} bytes")
            n = length // size
            first = max(self.lo - before, 0)
            last = n if self.hi is None else min(n, self.hi - before)
            for skip in range(first, last, step):
                parts.append(RecordRange(path, before + skip, skip, min(step, last - skip)))
            before += n
        return parts or [RecordRange("", 0, 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        size = self.width * self.dtype.itemsize
        filesystem, _ = _filesystem(self.path)
        rows = max(1, _BATCH_VALUES // self.width)
        small = self.dtype.itemsize < 4 or self.dtype.name == "int32"
        target = pa.float64() if self.dtype.kind == "f" else pa.int32() if small else pa.int64()
        with filesystem.open_input_file(partition.path) as f:
            for at in range(0, partition.count, rows):
                n = min(rows, partition.count - at)
                raw = f.read_at(n * size, (partition.skip + at) * size)
                values = pa.array(np.frombuffer(raw, self.dtype).astype(target.to_pandas_dtype()))
                offsets = pa.array(np.arange(0, (n + 1) * self.width, self.width, dtype=np.int32))
                numbers = np.arange(n, dtype=np.int64) + partition.first_record + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.ListArray.from_arrays(offsets, values)], ["record", "values"])


@dataclass
class PartWritten(WriterCommitMessage):
    temporary: str
    final: str


class FixedRecordWriter(DataSourceArrowWriter):
    """Each task writes a file of its own; the commit gives the files of the successful attempts their
    names, so a lost or repeated task leaves nothing behind."""

    def __init__(self, options):
        self.path, self.width = options["path"], int(options["width"])
        self.dtype = np.dtype(_TYPES[options["dtype"]][0])
        self.replace = str(options.get("replace", "false")).lower() == "true"

    def write(self, iterator):
        filesystem, root = _filesystem(self.path)
        part = TaskContext.get().partitionId()
        filesystem.create_dir(f"{root}/_temporary", recursive=True)
        temporary = f"{root}/_temporary/{part}-{uuid.uuid4().hex}"
        limits = np.iinfo(self.dtype) if self.dtype.kind in "iu" else None
        with filesystem.open_output_stream(temporary) as out:
            for batch in iterator:
                column = batch.column(batch.schema.get_field_index("values"))
                lengths = column.value_lengths()
                values = column.flatten().to_numpy(zero_copy_only=False)
                if lengths.null_count or (self.width and not np.all(lengths.to_numpy(zero_copy_only=False) == self.width)):
                    raise ValueError(f"every record needs {self.width} values")
                if limits is not None and len(values) and (values.min() < limits.min or values.max() > limits.max):
                    raise ValueError(f"a value does not fit {self.dtype}")
                out.write(values.astype(self.dtype).tobytes())
        return PartWritten(temporary, f"{root}/part-{part:06d}.bin")

    def commit(self, messages):
        filesystem, root = _filesystem(self.path)
        written = [m for m in messages if m is not None]
        # every new part is there before an old one goes
        for old, _ in _part_files(self.path) if self.replace else ():
            filesystem.delete_file(old)
        with ThreadPoolExecutor(16) as pool:  # a move can be a copy on an object store
            list(pool.map(lambda m: filesystem.move(m.temporary, m.final), written))
        filesystem.delete_dir(f"{root}/_temporary")

    def abort(self, messages):
        filesystem, _ = _filesystem(self.path)
        for m in messages:
            if m is not None:
                filesystem.delete_file(m.temporary)


def register(spark: SparkSession) -> None:
    """Make the format known; the classes travel with the job, executors need not have this package."""
    import eventspark.sources.binary as here

    cloudpickle.register_pickle_by_value(here)
    spark.dataSource.register(FixedRecordSource)


def in_order(rows: DataFrame, order: str) -> DataFrame:
    """Range partitions sorted by ``order``; put it before costly row-wise work, not after."""
    return rows.repartitionByRange(order).sortWithinPartitions(order)


def write_records(rows: DataFrame, path: str, dtype: str, width: int, order: str | None, overwrite: bool = False) -> None:
    """Arrays in column ``values``, in the order of a column, as flat binary. Width 0: any length.

    ``order`` None takes the rows as they are: partition by partition, which ``in_order`` prepares. Otherwise the rows
    are written once before, so that sampling the order reads one column and makes none of them a second time. A
    folder that holds records already is an error, or is emptied first with ``overwrite``.
    """
    old = _old_parts(path, overwrite)
    register(rows.sparkSession)
    ordered = rows if order is None else in_order(store(rows.select(order, "values"), "records"), order)
    (ordered.select(F.lit(0).cast("long").alias("record"), "values")
     .write.format(FORMAT).options(path=path, dtype=dtype, width=width, replace=old).mode("append").save())


def _old_parts(path: str, overwrite: bool) -> bool:
    """Are there records already? A stream of records has one writer: others' parts are an error, or replaced."""
    there = _filesystem(path)[0].get_file_info(_filesystem(path)[1])
    old = there.type != pafs.FileType.NotFound and bool(_part_files(path))
    if old and not overwrite:
        raise FileExistsError(f"{path} holds records already")
    return old


def read_records(spark: SparkSession, path: str, dtype: str, width: int, lo: int = 0, hi: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(FORMAT).options(path=path, dtype=dtype, width=width, lo=lo)
    return (reader if hi is None else reader.option("hi", hi)).load()


def _sidecar_path(path: str) -> str:
    return f"{path.rstrip('/')}.json"


def _write_sidecar(path: str, values: dict) -> None:
    filesystem, target = _filesystem(_sidecar_path(path))
    with filesystem.open_output_stream(target) as out:
        out.write(json.dumps(values, indent=4).encode())


def read_sidecar(path: str) -> dict:
    filesystem, target = _filesystem(_sidecar_path(path))
    if filesystem.get_file_info(target).type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no metadata beside {path}")
    with filesystem.open_input_stream(target) as f:
        return json.loads(f.read())


def write_dense_events(events: DataFrame, path: str) -> None:
    """Events padded to the largest one, with the sidecar that holds their shape."""
    events = store(events.select("event_id", "particles"), "events")
    shape = events.agg(F.count(F.lit(1)), F.max(F.size("particles"))).first()
    width = (shape[1] or 0) * len(RAW_FIELDS)
    flat = flat_values(in_order(events, "event_id"))
    write_records(pad_to(flat, "values", F.lit(0.0), width), path, "float64", width, None)
    _write_sidecar(path, {"output_data_filepath": path, "num_events": shape[0], "num_particles_max": shape[1] or 0})


def read_dense_events(spark: SparkSession, path: str) -> DataFrame:
    """Dense events -> (event_id, particles); padding rows (id 0 or NaN) are dropped."""
    shape, k = read_sidecar(path), len(RAW_FIELDS)
    rows = read_records(spark, path, "float64", shape["num_particles_max"] * k)

    def particle(i):
        return F.struct(*[F.get("values", i * k + j).cast("bigint" if f == "pdgid" else "double").alias(f)
                          for j, f in enumerate(RAW_FIELDS)])

    there = F.filter(F.sequence(F.lit(0), F.lit(shape["num_particles_max"] - 1)),
                     lambda i: ~F.isnan(F.get("values", i * k)) & (F.get("values", i * k) != 0.0))
    return rows.select(F.col("record").alias("event_id"), F.transform(there, particle).alias("particles"))


def write_tokens(sequences: DataFrame, path: str, length: int, order: str | None = "seq_id") -> None:
    """Sequences of one length as a flat two-byte token file."""
    write_records(sequences.withColumnRenamed("tokens", "values"), path, "uint16", length, order)


def write_token_lengths(lengths: DataFrame, path: str) -> None:
    """One two-byte length an event, aligned with the order of the events."""
    write_records(lengths.select("event_id", F.array("n_tokens").alias("values")), path, "uint16", 1, "event_id")


def read_tokens(spark: SparkSession, path: str, length: int, lo: int = 0, hi: int | None = None) -> DataFrame:
    """Token file -> (seq_id, tokens), optionally only sequences lo..hi-1."""
    return read_records(spark, path, "uint16", length, lo, hi).select(
        F.col("record").alias("seq_id"), F.col("values").alias("tokens"))
