"""Nearest neighbours by inner product with multiprobe p-stable hashing.

A table cuts space along ``HASHES`` Gaussian directions into strips of a common width; the strip numbers
of a vector are its bucket. To make the largest inner product the smallest distance, each vector gets one
more component that lifts it to the largest norm of all, and a query a zero there. A query visits its own
bucket and those one strip away in some directions, in order of the estimated chance that a neighbour
fell there: the squared distances to the crossed strip borders, smallest sums first. How many buckets it
visits is chosen on a bounded sample so that the sample's true neighbours are found. The candidates of
all tables are merged and ranked by their exact inner product.

Buckets are dealt out over cells by their hash. A cell with many vectors is salted, and its queries go to
every part of it. Equal vectors cannot crowd a cell: of each only the ids that can be among the nearest of
any query are candidates.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventspark.scratch import store

HASHES, TABLES, WIDTH = 6, 2, 2.0   # width in units of the largest norm
GROUP_ROWS = 20_000                 # vectors of a cell's part, and queries that meet them at once
SAMPLE_VECTORS, SAMPLE_QUERIES = 5000, 100
FOUND = 0.97                        # share of the sample's neighbours that the visited buckets hold
SEED = 20


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) with one row for an id, the smallest vector of a repeated id.

    Without rows that have no id, and vectors that are null, zero, or hold null or non-finite components.
    Only vectors of the commonest length are comparable; others take no part either.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (vectors.filter(F.col("vec_id").isNotNull() & F.col(embedding).isNotNull())
            .select("vec_id", x.alias("x")).filter(finite & F.exists("x", lambda v: v != 0)))
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    length = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(length.select("n")), F.size("x") == F.col("n"), "left_semi")


@dataclass
class Hashing:
    """The tables' directions and offsets, the width of a strip, and how many buckets a query visits."""

    directions: np.ndarray  # tables x (components + 1) x hashes
    offsets: np.ndarray     # tables x hashes
    width: float
    norm: float
    probes: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.norm ** 2 - (x * x).sum(axis=1), 0.0)
        return np.c_[x, np.sqrt(rest)]

    def strips(self, x: np.ndarray, table: int) -> np.ndarray:
        """Strip coordinates, whose whole parts are the bucket."""
        return (x @ self.directions[table] + self.offsets[table]) / self.width

    def visited(self, q: np.ndarray, table: int, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query its buckets in order of success (queries x probes x hashes) and their costs."""
        at = self.strips(np.c_[q, np.zeros(len(q))], table)
        own = np.floor(at)
        part = at - own
        moves = np.array(list(itertools.product((-1, 0, 1), repeat=at.shape[1])))
        costs = np.stack([part, np.zeros_like(part), 1.0 - part], axis=2) ** 2  # to move by -1, 0, +1
        cost = sum(costs[:, k, moves[:, k] + 1] for k in range(at.shape[1]))
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes or self.probes]
        return (own[:, None, :] + moves[order]).astype(np.int64), np.take_along_axis(cost, order, axis=1)


def bucket_keys(strips: np.ndarray) -> np.ndarray:
    """A number for each bucket (exact: eight bits for each strip number, far from its range)."""
    strips = np.clip(strips, -120, 120) + 128
    return (strips.astype(np.int64) << (8 * np.arange(strips.shape[-1]))).sum(axis=-1)


def fit(rows: DataFrame, queries: DataFrame, k: int, found: float = FOUND) -> Hashing:
    """Directions for ``rows(vec_id, x)`` and the number of visits, from a bounded sample of both tables."""
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).alias("norm"),
                     F.max(F.size("x")).alias("d")).first()
    n, d, norm = about["n"], about["d"] or 1, about["norm"] or 1.0
    rng = np.random.default_rng(SEED)
    shape = Hashing(rng.normal(size=(TABLES, d + 1, HASHES)), rng.uniform(0, 1, (TABLES, HASHES)) * WIDTH * norm,
                    WIDTH * norm, norm, 3 ** HASHES)

    def some(df, limit):
        got = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(limit).select("vec_id", "x").toArrow()
        return got["vec_id"].to_numpy(), np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, d)

    (ids, x), (q_ids, q) = some(rows, SAMPLE_VECTORS), some(queries, SAMPLE_QUERIES)
    if not len(x) or not len(q):
        return shape
    scores = np.where(q_ids[:, None] == ids, -np.inf, q @ x.T)
    near = np.argsort(-scores, axis=1)[:, :max(1, round(k * len(x) / n))]
    best = np.full((len(q), near.shape[1]), 3 ** HASHES)
    for table in range(TABLES):
        keys = bucket_keys(np.floor(shape.strips(shape.lifted(x), table)))
        probed = bucket_keys(shape.visited(q, table, 3 ** HASHES)[0])
        for row in range(len(q)):
            order = np.argsort(probed[row])
            at = np.minimum(np.searchsorted(probed[row][order], keys[near[row]]), len(order) - 1)
            rank = np.where(probed[row][order][at] == keys[near[row]], order[at], 3 ** HASHES)
            best[row] = np.minimum(best[row], rank)
    shape.probes = min(3 ** HASHES, int(np.quantile(best, found)) + 1)
    return shape


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, vec_id, score) of the k best of ``x`` for each query, scores summed the same way everywhere."""
    rough = np.where(q_ids[:, None] == ids, -np.inf, q @ x.T)
    m = min(len(ids), k + 12)
    at = np.argpartition(-rough, m - 1, axis=1)[:, :m] if m < len(ids) else np.broadcast_to(np.arange(len(ids)), rough.shape)
    edge = np.take_along_axis(rough, at, axis=1).min(axis=1)
    row, place = np.repeat(np.arange(len(q)), m), at.ravel()
    if m < len(ids):  # further ones that rounding cannot tell from the last
        extra = np.argwhere(rough >= (edge - 1e-12 * np.abs(edge))[:, None])
        row, place = extra[:, 0], extra[:, 1]
    keep = np.isfinite(rough[row, place])
    row, place = row[keep], place[keep]
    score = (q[row] * x[place]).sum(axis=1)
    order = np.lexsort((ids[place], -score, row))
    row, place, score = row[order], place[order], score[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[place[keep]], score[keep]


def search(vectors: DataFrame, every: int = 20, k: int = 20, hashing: Hashing | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Nearness is the largest inner product; ties go to the smaller id. A query with fewer than ``k``
    candidates gets all of them. Rows without an id, vectors that are null, zero, not finite, or of another
    length than most take no part; of a repeated id the smallest vector counts. An empty table gives an
    empty result.
    """
    rows = store(usable(vectors), "vectors")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    h = hashing or fit(rows, queries, k)
    # of equal vectors, a query can need the k smallest ids besides its own
    copies = Window.partitionBy("x").orderBy("vec_id")
    wanted = store(rows.withColumn("__copy", F.row_number().over(copies)).filter(F.col("__copy") <= k + 1)
                   .select("vec_id", "x"), "wanted")
    n, n_queries = wanted.count(), queries.count()
    cells = max(4, -(-n // GROUP_ROWS))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            for table in range(TABLES if len(x) else 0):
                key = bucket_keys(np.floor(h.strips(h.lifted(x), table)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), table, np.int32)), pa.array(cell_of(key)), pa.array(key),
                     batch.column("vec_id"), batch.column("x")], names=["table", "cell", "bucket", "vec_id", "x"])

    def cell_of(key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) % np.uint64(cells)).astype(np.int32)

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = _matrix(part.column("x"))
                for table in range(TABLES):
                    keys = bucket_keys(h.visited(x, table)[0])
                    cell = cell_of(keys)
                    for c in range(cells) if cells <= 64 else np.unique(cell):
                        here = cell == c
                        some = np.flatnonzero(here.any(axis=1))
                        if not len(some):
                            continue
                        ends = np.r_[0, np.cumsum(here[some].sum(axis=1))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), table, np.int32)), pa.array(np.full(len(some), c, np.int32)),
                             part.column("vec_id").take(pa.array(some)), part.column("x").take(pa.array(some)),
                             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[some][here[some]]))],
                            names=["table", "cell", "query_id", "q", "buckets"])

    placed_rows = store(wanted.mapInArrow(placed, "table int, cell int, bucket long, vec_id long, x array<double>"), "cells")
    parts = placed_rows.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    blocks = max(1, -(-n_queries // GROUP_ROWS))
    side_x = (placed_rows.join(parts, ["table", "cell"])
              .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = queries.mapInArrow(probing, "table int, cell int, query_id long, q array<double>, buckets array<long>")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, ids, x = left["bucket"].to_numpy(), left["vec_id"].to_numpy(), _matrix(left["x"])
        q, q_ids = _matrix(right["q"]), right["query_id"].to_numpy()
        lists = right["buckets"].combine_chunks()
        probe = lists.flatten().to_numpy()
        of = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        if not len(probe):  # a query that visits everything
            here = np.unique(bucket)
            probe, of = np.tile(here, len(q)), np.repeat(np.arange(len(q)), len(here))
        by_probe, by_bucket = np.argsort(probe, kind="stable"), np.argsort(bucket, kind="stable")
        probe, bucket = probe[by_probe], bucket[by_bucket]
        # the best so far of each query; buckets add to it one after the other
        top_id = np.full((len(q), k), -1, np.int64)
        top = np.full((len(q), k), -np.inf)
        for key in np.intersect1d(probe, bucket):
            asking = of[by_probe[np.searchsorted(probe, key):np.searchsorted(probe, key, "right")]]
            here = by_bucket[np.searchsorted(bucket, key):np.searchsorted(bucket, key, "right")]
            row, got, score = best_of(q[asking], q_ids[asking], x[here], ids[here], k)
            new_id = np.full((len(asking), k), -1, np.int64)
            new = np.full((len(asking), k), -np.inf)
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(asking)))[row]
            new_id[row, place], new[row, place] = got, score
            both_id, both = np.c_[top_id[asking], new_id], np.c_[top[asking], new]
            order = np.lexsort((both_id, -both), axis=1)[:, :k]
            top_id[asking], top[asking] = np.take_along_axis(both_id, order, 1), np.take_along_axis(both, order, 1)
        row, place = np.nonzero(top_id >= 0) if len(q) else (np.zeros(0, int), np.zeros(0, int))
        keep = np.isfinite(top[row, place])
        row, place = row[keep], place[keep]
        return pa.table({"query_id": q_ids[row], "vec_id": top_id[row, place], "score": top[row, place]})

    def ranked(asking: DataFrame) -> DataFrame:
        keys = ["table", "cell", "part", "block"]
        side_q = (asking.join(parts, ["table", "cell"])
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                  .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
        found = (side_x.select(*keys, "bucket", "vec_id", "x").groupBy(*keys)
                 .cogroup(side_q.select(*keys, "query_id", "q", "buckets").groupBy(*keys))
                 .applyInArrow(rank, "query_id long, vec_id long, score double"))
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))

    result = store(ranked(asked), "found")
    full = result.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = store(queries.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty() or n < 2:
        return result
    # the visited buckets held too few vectors: these queries see every cell of one table
    everywhere = short.select(F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"),
                              F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.array().cast("array<long>").alias("buckets"))
    return (result.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
            .unionByName(ranked(everywhere)))
