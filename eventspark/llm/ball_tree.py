"""Exact top-k search by inner product: branch and bound on a ball tree in each shard.

Vectors are dealt to cells around centres, and a cell with many vectors to parts, so every shard fits a
task however many vectors crowd one place. Each shard is indexed once as a row: its vectors in the order
of a ball tree's leaves, and the tree's balls. No vector in a ball with centre c and radius r has a larger
product with q than q.c + |q| r.

A query first searches the one shard where it expects the largest products. The kth score that it brings
back is shared with all others: cells whose bound is below it are never sent the query, and in the shards
that are, whole subtrees go unseen. Leaves are visited in the order of their bound, and the kth score of the
query rises as they are. Bounds carry a margin for rounding and scores are exact integers, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventspark.scratch import store

SCALE = 256.0
MAX_CELLS, CELL_ROWS = 1024, 4096  # the centres are sent to every task: at most so many
SHARD_VALUES = 1 << 20             # components of a shard: 8 MB
BLOCK_VALUES = 1 << 19             # components of the queries that meet a shard at once
LEAF_ROWS = 64
SAMPLE_VECTORS = 5000
_QUERIES_AT_ONCE = 1024
_MARGIN = 1e-9
_LOW, _HIGH = -(1 << 63) + 1, (1 << 63) - 1


def quantised(vectors: DataFrame, scale: float = SCALE, embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as whole numbers, one row for an id, the smallest v of a repeated id.

    Without rows that have no id and vectors that are null or hold null or non-finite components. Only
    vectors of the commonest length have products with each other; others take no part. Numbers beyond a
    long are its limits.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col(embedding).isNotNull()).select("vec_id", x.alias("x")).filter(finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.transform("x", lambda v: F.greatest(F.floor(v * scale), F.lit(_LOW))).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(length.select("n")), F.size("v") == F.col("n"), "left_semi")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``q`` and ``x``; those beyond a long are its limits."""
    top = np.abs(q.astype(float)).max(initial=0.0) * np.abs(x.astype(float)).max(initial=0.0) * max(1, q.shape[1])
    if top < 2.0 ** 53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if top < 2.0 ** 62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, _LOW + 1, _HIGH).astype(np.int64)


@dataclass
class Balls:
    """A shard: ids and vectors by leaf, and its balls, each parent before its children."""

    ids: np.ndarray     # of the vectors
    x: np.ndarray       # vectors x components, int64
    centre: np.ndarray  # balls x components
    radius: np.ndarray
    least: np.ndarray   # smallest id in a ball
    child: np.ndarray   # its first child, the second follows; 0 for a leaf
    lo: np.ndarray      # its vectors are lo to hi
    hi: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Balls:
        order = np.argsort(ids, kind="stable")
        at = x.astype(float)
        nodes, todo = [], [(0, len(ids))]
        child: list[int] = []
        for lo, hi in todo:
            rows = order[lo:hi]
            centre = at[rows].mean(axis=0)
            far = np.sqrt(((at[rows] - centre) ** 2).sum(axis=1))
            nodes.append((centre, far.max(), ids[rows].min(), lo, hi))
            if hi - lo <= leaf_rows:
                child.append(0)
                continue
            one = at[rows[far.argmax()]]
            other = at[rows[((at[rows] - one) ** 2).sum(axis=1).argmax()]]
            # halves along the line between two far vectors; equal vectors stay in order of their ids
            order[lo:hi] = rows[np.argsort(at[rows] @ (other - one), kind="stable")]
            child.append(len(todo))
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        centre, radius, least, lo, hi = (np.array(c) for c in zip(*nodes))
        return cls(ids[order], x[order], centre.reshape(len(nodes), x.shape[1]), radius, least, np.array(child), lo, hi)

    _NUMBERS = {"ids": np.int64, "x": np.int64, "centre": np.float64, "radius": np.float64, "least": np.int64,
                "child": np.int64, "lo": np.int64, "hi": np.int64}

    def row(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self._NUMBERS.items()}

    @classmethod
    def of(cls, row: dict) -> Balls:
        got = {name: np.frombuffer(row[name], kind) for name, kind in cls._NUMBERS.items()}
        got["x"] = got["x"].reshape(len(got["ids"]), -1) if len(got["x"]) else np.zeros((len(got["ids"]), 0), np.int64)
        got["centre"] = got["centre"].reshape(len(got["radius"]), got["x"].shape[1])
        return cls(**got)


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """No vector within ``radius`` of ``centre`` has a larger whole product with ``q`` (queries x balls)."""
    length = np.sqrt((q * q).sum(axis=1))[:, None]
    slack = _MARGIN * length * (np.sqrt((centre * centre).sum(axis=1)) + radius)
    return np.floor(q @ centre.T + length * radius + slack)


class Best:
    """The k best of each query so far, and the score and id that a candidate has to beat."""

    def __init__(self, n: int, k: int, score: np.ndarray, ident: np.ndarray):
        self.score, self.ident = np.full((n, k), _LOW), np.full((n, k), _HIGH)
        self.to_beat, self.beat_id = score.copy(), ident.copy()

    def open(self, rows, bound, least) -> np.ndarray:
        """Can a ball with this bound and smallest id still hold a better one?"""
        to_beat = self.to_beat[rows]
        # compared as doubles: a score that rounds up must not hide an equal bound
        return (bound > to_beat.astype(float)) | ((bound >= to_beat.astype(float)) & ((np.abs(bound) >= 2.0 ** 53) | (least <= self.beat_id[rows])))

    def offer(self, rows: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        some = (score >= self.to_beat[rows][:, None]).any(axis=1)
        rows, score = rows[some], score[some]
        if not len(rows):
            return
        both = np.c_[self.score[rows], score]
        ids = np.c_[self.ident[rows], np.where(score == _LOW, _HIGH, np.broadcast_to(ident, score.shape))]
        first = np.lexsort((ids, -both), axis=1)[:, :self.score.shape[1]]
        self.score[rows], self.ident[rows] = np.take_along_axis(both, first, 1), np.take_along_axis(ids, first, 1)
        last, last_id = self.score[rows, -1], self.ident[rows, -1]
        better = (last > self.to_beat[rows]) | ((last == self.to_beat[rows]) & (last_id < self.beat_id[rows]))
        self.to_beat[rows[better]], self.beat_id[rows[better]] = last[better], last_id[better]


def search_shard(shard: Balls, q: np.ndarray, q_ids: np.ndarray, k: int, score: np.ndarray, ident: np.ndarray) -> Best:
    """The k best of the shard for each query that are no worse than the given score and id; counts what it saw."""
    best, direction = Best(len(q), k, score, ident), q.astype(float)
    best.seen = 0

    def visit(leaf: int, rows: np.ndarray) -> None:
        here = slice(shard.lo[leaf], shard.hi[leaf])
        got = products(q[rows], shard.x[here])
        best.seen += got.size
        best.offer(rows, np.where(q_ids[rows][:, None] == shard.ids[here], _LOW, got), shard.ids[here])

    # the leaf that the larger bound leads to, for a kth score to begin with
    everyone = np.arange(len(q))
    first = np.zeros(len(q), np.int64)
    while (inner := shard.child[first] > 0).any():
        for ball in np.unique(first[inner]):
            rows = everyone[first == ball]
            pair = shard.child[ball] + np.arange(2)
            first[rows] = pair[bounds(direction[rows], shard.centre[pair], shard.radius[pair]).argmax(axis=1)]
    for leaf in np.unique(first):
        visit(leaf, everyone[first == leaf])

    # level by level, balls that some query may still need
    balls, alive = np.zeros(1, np.int64), np.ones((len(q), 1), bool)
    leaves, leaf_bounds = [], []
    while len(balls):
        bound = bounds(direction, shard.centre[balls], shard.radius[balls])
        alive &= best.open(everyone[:, None], bound, shard.least[balls])
        some = alive.any(axis=0)
        balls, alive, bound = balls[some], alive[:, some], bound[:, some]
        is_leaf = shard.child[balls] == 0
        leaves.append(balls[is_leaf])
        leaf_bounds.append(np.where(alive[:, is_leaf], bound[:, is_leaf], -np.inf))
        inner = balls[~is_leaf]
        alive = np.repeat(alive[:, ~is_leaf], 2, axis=1)
        balls = (shard.child[inner][:, None] + np.arange(2)).ravel()
    leaves, leaf_bounds = np.concatenate(leaves), np.concatenate(leaf_bounds, axis=1)
    leaf_bounds[leaves[None, :] == first[:, None]] = -np.inf  # seen already
    # the best leaf of each query, the next two, the next four ...: the kth score rises in between
    order = np.argsort(-leaf_bounds, axis=1, kind="stable")
    at, step = 0, 1
    while at < len(leaves):
        rows = np.repeat(everyone, min(step, len(leaves) - at))
        which = order[:, at:at + step].ravel()
        bound = leaf_bounds[rows, which]
        go = np.isfinite(bound) & best.open(rows, bound, shard.least[leaves[which]])
        rows, which, bound = rows[go], which[go], bound[go]
        by_leaf = np.argsort(which, kind="stable")
        for part in np.split(by_leaf, np.flatnonzero(np.diff(which[by_leaf])) + 1) if len(by_leaf) else ():
            leaf = leaves[which[part[0]]]
            part = part[best.open(rows[part], bound[part], shard.least[leaf])]
            if len(part):
                visit(leaf, rows[part])
        at, step = at + step, 2 * step
    return best


def _numbers(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def _centres(rows: DataFrame, n: int, d: int, cell_rows: int) -> np.ndarray:
    """At most ``MAX_CELLS`` centres by a few rounds of k-means on a bounded sample (only cost depends on them)."""
    cells = int(min(MAX_CELLS, max(1, -(-n // cell_rows))))
    sample = _numbers(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_VECTORS).select("v").toArrow()["v"], d).astype(float)
    centre = sample[:cells]
    for _ in range(5):
        near = _nearest(sample, centre)[0]
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=len(centre))[:, None]
        centre = np.where(count > 0, sums / np.maximum(count, 1), centre)
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = ((centre * centre).sum(axis=1) - 2 * x @ centre.T).argmin(axis=1)
    return near, np.sqrt(((x - centre[near]) ** 2).sum(axis=1))


def search(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = SCALE, cell_rows: int = CELL_ROWS,
           shard_values: int = SHARD_VALUES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest products of each row whose id is divisible by ``every``.

    Products are of ``quantised`` vectors; ties go to the smaller id; a query with fewer than ``k``
    candidates gets all of them. Zero vectors take part, rows without an id, null vectors, null or non-finite
    components and vectors of another length than most do not. An empty table gives an empty result.
    Columns besides ``vec_id`` and ``embedding`` are not looked at.
    """
    rows = store(quantised(vectors, scale), "whole")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, d = about["n"], about["d"] or 0
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centre = _centres(rows, n, d, cell_rows)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = _nearest(_numbers(batch.column("v"), d).astype(float), centre)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), batch.column("vec_id"), batch.column("v")],
                                             names=["cell", "far", "vec_id", "v"])

    cells = store(rows.mapInArrow(placed, "cell int, far double, vec_id long, v array<long>"), "cells")
    shard_rows = max(leaf_rows, shard_values // max(1, d))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"), F.max("far").alias("far"))
    known = {r["cell"]: (r["parts"], r["far"]) for r in sizes.collect()}  # at most MAX_CELLS
    used = np.array(sorted(known))
    parts, radius = np.array([known[c][0] for c in used]), np.array([known[c][1] for c in used])
    middle = centre[used]

    def index(group: pa.Table) -> pa.Table:
        shard = Balls.build(group["vec_id"].to_numpy(), _numbers(group["v"], d), leaf_rows).row()
        return pa.table({"cell": group["cell"][:1], "part": group["part"][:1], **{name: pa.array([b], pa.binary()) for name, b in shard.items()}})

    dealt = (cells.join(F.broadcast(sizes.select("cell", "parts")), "cell")
             .select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v"))
    shards = store(dealt.groupBy("cell", "part").applyInArrow(
        index, "cell int, part int, " + ", ".join(f"{name} binary" for name in Balls._NUMBERS)), "shards")
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    none, any_id = F.lit(_LOW).cast("long"), F.lit(_HIGH).cast("long")
    blocks = max(1, -(-queries.count() * max(1, d) // BLOCK_VALUES))

    def begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = (_numbers(batch.column("v"), d).astype(float) @ middle.T).argmax(axis=1)
            part = batch.column("vec_id").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(used[cell].astype(np.int32)),
                                              pa.array(part.astype(np.int32))], names=["vec_id", "v", "cell", "part"])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _QUERIES_AT_ONCE):
                batch = whole.slice(lo, _QUERIES_AT_ONCE)
                seen_cell, seen_part, score = (batch.column(c).to_numpy() for c in ("cell", "part", "to_beat"))
                need = bounds(_numbers(batch.column("v"), d).astype(float), middle, radius) >= score.astype(float)[:, None]
                for c in np.flatnonzero(need.any(axis=0)):
                    for p in range(parts[c]):
                        rows = np.flatnonzero(need[:, c] & ((seen_cell != used[c]) | (seen_part != p)))
                        if len(rows):
                            take = pa.array(rows)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(rows), used[c], np.int32)), pa.array(np.full(len(rows), p, np.int32)),
                                 *(batch.column(name).take(take) for name in ("vec_id", "v", "to_beat", "beat_id"))],
                                names=["cell", "part", "query_id", "q", "to_beat", "beat_id"])

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            shard = Balls.of(left.slice(0, 1).to_pylist()[0])
            q, q_ids, score, ident = (_numbers(right["q"], d), *(right[c].to_numpy() for c in ("query_id", "to_beat", "beat_id")))
            for lo in range(0, len(q), _QUERIES_AT_ONCE):
                some = slice(lo, lo + _QUERIES_AT_ONCE)
                best = search_shard(shard, q[some], q_ids[some], k, score[some], ident[some])
                start, start_id = score[some, None], ident[some, None]
                row, place = np.nonzero((best.score > _LOW) & ((best.score > start) | ((best.score == start) & (best.ident <= start_id))))
                found.append((q_ids[some][row], best.ident[row, place], best.score[row, place]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    def asked(wave: DataFrame) -> DataFrame:
        keys = ["cell", "part", "block"]
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        side = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return side.groupBy(*keys).cogroup(wave.withColumn("block", block).groupBy(*keys)).applyInArrow(
            rank, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # where a query begins is written: the second wave leaves out exactly that shard
    queries = store(queries.mapInArrow(begins, "vec_id long, v array<long>, cell int, part int"), "queries")
    first = store(asked(queries.select("cell", "part", F.col("vec_id").alias("query_id"), F.col("v").alias("q"),
                                       none.alias("to_beat"), any_id.alias("beat_id"))), "found")
    kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("to_beat"), F.col("vec_id").alias("beat_id"))
    waiting = queries.join(kth, "vec_id", "left").select("vec_id", "v", "cell", "part", F.coalesce("to_beat", none).alias("to_beat"),
                                                         F.coalesce("beat_id", any_id).alias("beat_id"))
    found = first.unionByName(asked(waiting.mapInArrow(
        to_others, "cell int, part int, query_id long, q array<long>, to_beat long, beat_id long")))
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
