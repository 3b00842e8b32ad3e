"""Small helpers that several of these operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample that a classifier is fitted on: rows for each class, bytes of text in all.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 64 << 20
#: A single text above this share of the bytes is not learned from.
TEXT_SHARE = 16


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once a session: their workers import it."""
    if getattr(spark.sparkContext, "_eventspark_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="eventspark-"), "eventspark.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("eventspark", os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(target)
    spark.sparkContext._eventspark_shipped = True


def shipped(query):
    """A function of (spark, ...) that sends the package before it runs."""
    @functools.wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def is_held_out(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True for rows that no model learns from; a row without an id is one of them."""
    return F.coalesce(fold(column, modulus) == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int,
                    which: Column) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` training documents of each class and ``max_bytes`` in all.

    The rows with the smallest hash of their id are taken, so the sample is the same for every layout of
    the tables. Ids are chosen before any text is read; hashes and sizes of the texts then come by a join with at
    most ``2 * rows`` ids, one for each id (of a repeated id the text with the smallest hash), and only the
    texts that are left are fetched. A single text above ``max_bytes / TEXT_SHARE`` is passed over, the texts behind
    it are not. Labels of a repeated id count once, as the largest.
    """
    known = (labels.filter(which & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
             .withColumn("__order", F.xxhash64("doc_id")))
    ids = None
    for value in (0, 1):
        some = known.filter(F.col("__label") == value).orderBy("__order", "doc_id").limit(rows)
        ids = some if ids is None else ids.unionByName(some)
    return sample_texts(docs, ids, max_bytes)


def sample_texts(docs: DataFrame, ids: DataFrame, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) for ``ids(doc_id, __order, __label)``, a bounded table, in that order and within ``max_bytes``."""
    text = F.coalesce("text", F.lit(""))
    sized = (docs.select("doc_id", F.xxhash64(text).alias("__hash"), F.octet_length(text).cast("long").alias("__bytes"))
             .join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__order", "__label")
             .agg(F.min(F.struct("__hash", "__bytes")).alias("__text")).select("doc_id", "__order", "__label", "__text.*"))
    fit = sized.filter(F.col("__bytes") <= max_bytes // TEXT_SHARE)
    so_far = Window.orderBy("__order", "doc_id", "__label")  # numbers of the bounded sample
    kept = (fit.withColumn("__upto", F.sum("__bytes").over(so_far)).withColumn("__rank", F.row_number().over(so_far))
            .filter(F.col("__upto") <= max_bytes).select("doc_id", "__hash", "__label", "__rank"))
    found = (docs.select("doc_id", text.alias("__text"), F.xxhash64(text).alias("__hash"))
             .join(F.broadcast(kept), ["doc_id", "__hash"]).select("__rank", "__label", "__text"))
    # copies of a text drop out in each task before they meet
    texts = found.mapInArrow(_first_of_each, found.schema).groupBy("__rank").agg(F.min(F.struct("__text", "__label")).alias("t"))
    return [(r[0], r[1]) for r in texts.orderBy("__rank").select("t.__text", "t.__label").toLocalIterator()]


def texts_at_once(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of an array of texts that hold about ``most`` bytes each, or one text."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float))
    lo, so_far = 0, 0.0
    for k, size in enumerate(sizes):
        if so_far and so_far + size > most:
            yield lo, k
            lo, so_far = k, 0.0
        so_far += size
    if lo < len(sizes):
        yield lo, len(sizes)


def map_texts(docs: DataFrame, schema, worker: Callable[[], Callable[[pa.RecordBatch, list], pa.RecordBatch]], text: str = "text") -> DataFrame:
    """``docs`` mapped to ``schema`` some megabytes of text at a time.

    ``worker()`` is called once a task and gives a function of (rows, their texts). Rows pass through it as
    Arrow columns, none waits in the JVM for its score, and what a task took goes back to the system at its end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = worker()
        try:
            for batch in batches:
                column = batch.column(text)
                for lo, hi in texts_at_once(column):
                    yield work(batch.slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist())
        finally:
            del work
            give_back()

    return docs.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that is free but held to the system: workers live on, and their executor has little to spare."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        new = []
        for k, rank in enumerate(batch.column("__rank").to_pylist()):
            if rank not in seen:
                seen.add(rank)
                new.append(k)
        if new:
            yield batch.take(pa.array(new))


def mixed(z: np.ndarray) -> np.ndarray:
    """A well-spread number for each number (unsigned, modulo 2^64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))
