"""The trie of conversation prefixes, with what it saves.

A turn is a number of 120 bits from its SHA-256, so only numbers and text lengths are shuffled. Conversations
are rows of turn ids, dealt to shards by ranges of (ids, conversation): a node's members lie side by side, and
conversations alike in every turn can be spread over many shards. In a shard the ids form matrices, padded
where a conversation is shorter; ``np.lexsort`` orders the rows, changes of a column against the row above,
OR-accumulated from left to right, mark where nodes start, and ``reduceat`` sums every depth. Only nodes on the
paths of a shard's first and last row can go on in another shard; their parts are added up by key.

Matrices hold ``COLUMNS`` turns at a time, and only the rows that reach them, so one very long conversation
pads nothing. A conversation's ids, 24 bytes a turn, are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventspark.llm.common import mixed
from eventspark.scratch import store

BASE_EVERY, MOST_SHARED = 100, 6
SHARD_TURNS = 200_000
COLUMNS = 64
ENDS_A_ROW = 512   # ids of one piece of a boundary node's list
_NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, base_every: int = BASE_EVERY, most_shared: int = MOST_SHARED) -> DataFrame:
    """(conv_id, ids, chars): the turns of every rebuilt conversation, two numbers and a text length for each.

    Turns are ordered by ``turn`` (null first), equal ones by their id; null role or text counts as empty.
    Conversation c begins with the first h turns of conversation c - c % ``base_every`` (all if fewer, none if
    absent), h = crc32 of c in decimal modulo ``most_shared``, and goes on with its own turns after its first h.
    Rows without a conversation id belong to none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    number = lambda lo: F.conv(F.substring(digest, lo, 15), 16, 10).cast("long")
    small = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", number(1).alias("id"), number(16).alias("id2"),
        F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id", "id2")
    h = F.crc32(F.col("conv_id").cast("string")) % most_shared
    placed = store(small.withColumn("i", F.row_number().over(order) - 1).withColumn("h", h), "turns")
    heads = placed.filter((F.col("conv_id") % base_every == 0) & (F.col("i") < most_shared)).select(
        F.col("conv_id").alias("base"), "i", "id", "id2", "chars")
    known = placed.filter(F.col("i") == 0).select("conv_id", "h")
    # a base is asked by no more than base_every conversations on each side of 0
    shared = (known.withColumn("base", F.col("conv_id") - F.col("conv_id") % base_every).join(heads, "base")
              .filter(F.col("i") < F.col("h")).select("conv_id", F.lit(0).alias("own"), "i", "id", "id2", "chars"))
    own = placed.filter(F.col("i") >= F.col("h")).select("conv_id", F.lit(1).alias("own"), "i", "id", "id2", "chars")
    none = F.lit(None)
    empty = known.select("conv_id", F.lit(2).alias("own"), F.lit(0).alias("i"), none.cast("long").alias("id"),
                         none.cast("long").alias("id2"), none.cast("long").alias("chars"))
    rows = shared.unionByName(own).unionByName(empty)
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("own") < 2, F.struct("own", "i", "id", "id2", "chars")))).alias("s"))
    return listed.select("conv_id", F.flatten(F.transform("s", lambda x: F.array(x["id"], x["id2"]))).alias("ids"),
                         F.transform("s", lambda x: x["chars"]).alias("chars"))


def _spread(ids: np.ndarray, depth: int) -> np.ndarray:
    """Two numbers for each turn id and its place; their sums from the root on name a node."""
    place = mixed(np.arange(depth + 1, depth + 1 + ids.shape[1], dtype=np.uint64))[:, None]
    a, b = (mixed(ids[..., k].astype(np.uint64) + place[:, 0] + np.uint64(k)) for k in (0, 1))
    return np.stack([mixed(a + np.uint64(3) * b), mixed(a ^ (np.uint64(5) * b))], axis=2)


class Shard:
    """The nodes that the conversations of a shard form, by depth from 0 (the root)."""

    def __init__(self, conv: np.ndarray, length: np.ndarray, ids: np.ndarray, chars: np.ndarray):
        """``ids`` (two columns) and ``chars`` hold the turns of all conversations, one after the other."""
        first = (np.cumsum(length) - length).astype(np.int64)
        order = self._sorted(conv, length, ids, first)
        self.conv, self.length, first = conv[order], length[order], first[order]
        n = len(conv)
        rows, change, key = np.arange(n), np.r_[True, np.zeros(n - 1, bool)], np.zeros((n, 2), np.uint64)
        # for each depth: the rows that reach it, where nodes start among them, the nodes' names, their last text
        self.levels = [(rows, np.zeros(1, np.int64), key[:1], np.zeros(1, np.int64))]
        depth = 0
        while (kept := np.flatnonzero(self.length[rows] > depth)).size:
            node = np.cumsum(change)[kept]
            fresh = np.r_[True, node[1:] != node[:-1]]
            rows = rows[kept]
            m = self._matrix(ids, first[rows], self.length[rows], depth)
            differs = np.ones(m.shape[:2], bool)
            differs[1:] = (m[1:] != m[:-1]).any(axis=2)
            # a row that differs from the one above it in a column starts a node there and in all columns behind
            masks = np.logical_or.accumulate(np.c_[fresh, differs], axis=1)[:, 1:]
            keys = key[kept][:, None] + np.cumsum(_spread(m, depth), axis=1, dtype=np.uint64)
            for j in range(m.shape[1]):
                on = np.flatnonzero(self.length[rows] > depth + j)
                starts = np.flatnonzero(masks[on, j])
                heads = on[starts]
                self.levels.append((rows[on], starts, keys[heads, j], chars[first[rows[heads]] + depth + j]))
            change, key, depth = masks[:, -1], keys[:, -1], depth + COLUMNS

    @staticmethod
    def _matrix(ids: np.ndarray, first: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
        """Rows x at most COLUMNS turns x 2 from ``depth`` on, padded with -1."""
        width = int(np.clip((length - depth).max(initial=0), 0, COLUMNS))
        out = np.full((len(first), width, 2), -1, np.int64)
        for j in range(width):
            there = np.flatnonzero(length > depth + j)
            out[there, j] = ids[first[there] + depth + j]
        return out

    @classmethod
    def _sorted(cls, conv, length, ids, first) -> np.ndarray:
        """Rows by their turns, shorter ones before those that go on, equal ones by conversation."""
        rank, rows, depth = np.zeros(len(conv), np.int64), np.arange(len(conv)), 0
        while len(rows):
            m = cls._matrix(ids, first[rows], length[rows], depth)
            columns = [m[:, j, k] for j in range(m.shape[1]) for k in (0, 1)]
            by = np.lexsort((*columns[::-1], rank[rows]))
            old = rank[rows][by]
            other = np.r_[True, old[1:] != old[:-1]]
            new = other.copy()
            new[1:] |= (m[by[1:]] != m[by[:-1]]).any(axis=(1, 2))
            # a rank is the place in the whole order where its rows begin
            place = np.arange(len(by))
            rank[rows[by]] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(other, place, 0))
            depth += COLUMNS
            ended = np.bincount(rank[length <= depth], minlength=len(conv))
            rows = rows[length[rows] > depth]
            rank[rows] += ended[rank[rows]]  # rows that go on stand behind those of their rank that end here
        return np.lexsort((conv, rank))

    def nodes(self) -> Iterator[dict[str, np.ndarray]]:
        """For each depth, the deepest first: its nodes with their members, children and subtree inside this shard.

        ``edge`` nodes hold the shard's first or last row. What such a node adds to its subtree by itself is
        known only when its parts in other shards are, so sums leave it out.
        """
        n_rows = len(self.conv)
        acc = np.zeros((n_rows, 2), np.int64)  # leaves and savings of deeper nodes, at a row of theirs
        below, below_edge = np.zeros(0, np.int64), np.zeros(0, bool)
        for depth in range(len(self.levels) - 1, -1, -1):
            rows, starts, key, chars = self.levels[depth]
            head, last = rows[starts], rows[np.r_[starts[1:], len(rows)] - 1]
            n = np.diff(np.r_[starts, len(rows)])
            edge = (head == 0) | (last == n_rows - 1)
            inner = below[~below_edge]
            children = np.searchsorted(inner, np.r_[head[1:], n_rows]) - np.searchsorted(inner, head)
            inside = np.add.reduceat(acc[rows], starts, axis=0)
            own = np.where(edge[:, None], 0, np.c_[children == 0, (n - 1) * chars])
            acc[head] += own
            parent = {}
            if depth:
                above, above_starts, above_key, _ = self.levels[depth - 1]
                of = np.searchsorted(above[above_starts], head, "right") - 1
                above_last = above[np.r_[above_starts[1:], len(above)] - 1]
                parent = {"parent_key": above_key[of], "parent_conv_id": np.minimum.reduceat(self.conv[above], above_starts)[of],
                          "parent_edge": ((above[above_starts] == 0) | (above_last == n_rows - 1))[of]}
            yield {"depth": depth, "key": key, "n_convs": n, "conv_id": np.minimum.reduceat(self.conv[rows], starts), "chars": chars,
                   "n_children": children, "n_leaves": inside[:, 0] + own[:, 0], "saved_tokens": inside[:, 1] + own[:, 1], "edge": edge,
                   "head": head, "last": last, "n_ends": np.add.reduceat((self.length[rows] == depth).astype(np.int64), starts), **parent}
            below, below_edge = head, edge


_FIELDS = ("kind int, shard int, path int, both boolean, depth long, k1 long, k2 long, pk1 long, pk2 long, n_convs long, conv_id long, "
           "parent_conv_id long, parent_edge boolean, n_children long, n_leaves long, saved_tokens long, chars long, piece long, ends string")
_INNER, _EDGE, _PIECE = 0, 1, 2
_ROWS_AT_ONCE = 20_000


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of conversations to its nodes, and the members that edge nodes end with, in pieces."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    lengths = table["chars"].chunk(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    shard = Shard(table["conv_id"].to_numpy(), lengths, table["ids"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2),
                  table["chars"].chunk(0).flatten().to_numpy(zero_copy_only=False))
    number = TaskContext.get().partitionId()
    schema = [(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]])
              for f in _FIELDS.split(", ")]
    waiting: list[dict] = []

    def flushed(everything: bool) -> Iterator[pa.RecordBatch]:
        if waiting and (everything or sum(len(w["k1"]) for w in waiting) >= _ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.broadcast_to(w.get(name, 0), len(w["k1"])) for w in waiting]).astype(object if name == "ends" else None), kind)
                 for name, kind in schema], names=[name for name, _ in schema])
            waiting.clear()

    for level in shard.nodes():
        keys = level["key"].view(np.int64)
        above = level.get("parent_key", np.zeros_like(level["key"])).view(np.int64)
        ends = np.full(len(keys), _NOTHING, object)
        for k in np.flatnonzero((level["n_ends"] > 0) & ~level["edge"]):
            members = shard.conv[level["head"][k]:level["head"][k] + level["n_ends"][k]]
            ends[k] = hashlib.sha256(",".join(map(str, members)).encode()).hexdigest()
        waiting.append({
            "kind": level["edge"].astype(np.int32), "shard": number, "path": np.where(level["head"] == 0, 0, 1),
            "both": (level["head"] == 0) & (level["last"] == len(shard.conv) - 1), "depth": level["depth"], "k1": keys[:, 0], "k2": keys[:, 1],
            "pk1": above[:, 0], "pk2": above[:, 1], "parent_edge": level.get("parent_edge", False), "ends": ends,
            **{name: level.get(name, 0) for name in ("n_convs", "conv_id", "parent_conv_id", "n_children", "n_leaves", "saved_tokens", "chars")}})
        for k in np.flatnonzero((level["n_ends"] > 0) & level["edge"]):
            for lo in range(0, level["n_ends"][k], ENDS_A_ROW):
                members = shard.conv[level["head"][k] + lo:level["head"][k] + min(lo + ENDS_A_ROW, level["n_ends"][k])]
                waiting.append({"kind": _PIECE, "shard": number, "both": False, "depth": level["depth"], "k1": keys[k:k + 1, 0], "k2": keys[k:k + 1, 1],
                                "parent_edge": False, "piece": lo // ENDS_A_ROW, "ends": np.array([",".join(map(str, members))], object)})
        yield from flushed(False)
    yield from flushed(True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest for each node, a piece at a time."""
    at, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in at] + [pa.array([state.hexdigest()])], names=["depth", "k1", "k2", "digest"])

    for batch in batches:
        for *node, text in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ends"))):
            if node != at:
                if at is not None:
                    yield done()
                at, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if at is not None:
        yield done()


def nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node.

    Nodes are the distinct beginnings of the conversations of ``sequences(turns)``, from the root without
    turns; see there for nulls and ties. Repeated rows are turns like others. An empty table has no nodes.
    """
    convs = store(sequences(turns), "sequences")
    n = convs.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    dealt = convs.repartitionByRange(max(1, -(-n // shard_turns)), "ids", "conv_id")
    made = store(dealt.mapInArrow(_shard_rows, _FIELDS), "nodes")
    key, above = ["depth", "k1", "k2"], [(F.col("depth") - 1).alias("depth"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2")]
    parts = made.filter(F.col("kind") == _EDGE)
    whole = parts.groupBy(*key).agg(
        F.min("shard").alias("owner"), F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_children").alias("inner"),
        F.first("chars").alias("chars"), F.first("pk1").alias("pk1"), F.first("pk2").alias("pk2"))
    whole = whole.join(whole.filter("depth > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("more")), key, "left")
    whole = store(whole.select(*key, "owner", "n", "least", "pk1", "pk2", (F.col("inner") + F.coalesce("more", F.lit(0))).alias("children"), "chars"), "edges")
    # what edge nodes add themselves counts in one of their shards, for the nodes above them on the same path
    placed = parts.join(whole.drop("pk1", "pk2").withColumnRenamed("chars", "text"), key)
    owned = lambda c: F.when(F.col("owner") == F.col("shard"), c).otherwise(0)
    placed = placed.withColumns({"own_leaf": owned((F.col("children") == 0).cast("long")), "own_saved": owned((F.col("n") - 1) * F.col("text"))})
    deeper = Window.partitionBy("shard", "path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    of_shard = Window.partitionBy("shard")  # the nodes of two paths

    def subtree(inside, own):
        other = F.sum(F.when(F.col("path") == 1, F.col(own)).otherwise(0)).over(of_shard)
        return F.col(inside) + F.sum(own).over(deeper) + F.when(F.col("both"), other).otherwise(0)

    sums = placed.select(*key, subtree("n_leaves", "own_leaf").alias("leaves"), subtree("saved_tokens", "own_saved").alias("saved")).groupBy(*key).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    digests = (made.filter(F.col("kind") == _PIECE).select(*key, "shard", "piece", "ends").repartition(*key).sortWithinPartitions(*key, "shard", "piece")
               .mapInArrow(_digests, "depth long, k1 long, k2 long, digest string"))
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("least").alias("parent"))
    edges = (whole.join(sums, key).join(digests, key, "left").join(parents, ["depth", "pk1", "pk2"], "left").select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("digest", F.lit(_NOTHING)).alias("ends_sha256")))
    inner = made.filter(F.col("kind") == _INNER)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    # the parent's part in the same shard: no key has more rows than a shard
    near = placed.select("shard", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("least").alias("parent"))
    joined = (inner.filter("parent_edge").drop("parent_conv_id").join(near, ["shard", "depth", "pk1", "pk2"])
              .withColumnRenamed("parent", "parent_conv_id"))
    return edges.unionByName(inner.filter("not parent_edge").select(*columns)).unionByName(joined.select(*columns))
