"""Near copies among embeddings on a robust-pruned flat graph.

Vectors of a label are dealt to overlapping shards: each goes to the nearest ``overlap`` of some centres, and a
shard that is still large is dealt again, around other centres, then by a hash of the ids. In a shard, every
vector gets a robust-pruned list: its near ones, without those that a nearer one of the list leads to. The list
of a vector is the union of its lists in all shards that hold it: a walk that meets the vector goes on in each.

Every vector is a query. It walks the shards that hold it, greedily from their medoids and itself; all
that it meets within range is expanded, whatever the beam. What it met may lie in other shards too: in rounds
of joins the query, with these vectors to start from, goes to the shards that it has not walked, until none is
left. Links are verified by their cosine in double precision, so none below the threshold is reported.

Each run audits its recall: the links of a sample of ids are counted against all vectors of their label, and
if fewer than ``RECALL`` of them were found, the graph is built again with more overlap.

Equal vectors are one entry with a count. Links are counted, not listed: a shard passes on one row for each
linked vector and the head of its local group, from which the components follow. Cosines are worked out for
the pairs that walks meet and inside shards, never for all pairs of a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import mixed
from eventspark.llm.components import connected
from eventspark.llm.gray_simhash import Groups
from eventspark.scratch import store

THRESHOLD = 0.93
SHARD_ROWS, MOST_ROWS = 500, 1500  # aimed at in a shard, and the most before it is dealt again
MOST_CENTRES = 4096                # sent to every task; a sample of as many vectors
LEVELS = 2                         # of centres, before what is still large is dealt by a hash
SHARD_VALUES = 4 << 20             # components of a shard at most: 32 MB
BLOCK_ROWS = 4096                  # queries that walk a shard at once
POOL, DEGREE, ALPHA, BEAM = 48, 12, 1.2, 16
OVERLAP, MOST_OVERLAP = 2, 8       # shards that hold a vector, at each level
AUDIT_ROWS, RECALL = 200, 0.99     # ids whose links are counted again, and the share of them to be found
SEED = 2


# --- the graph of one shard ---------------------------------------------------

def robust_prune(z: np.ndarray, pool: int = POOL, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists of unit vectors, edges in both directions."""
    n = len(z)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    near = z @ z.T
    np.fill_diagonal(near, -np.inf)
    c = min(pool, n - 1)
    at = np.argpartition(-near, c - 1, axis=1)[:, :c]
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)
    length = np.sqrt(np.maximum(2.0 - 2.0 * np.take_along_axis(near, at, 1), 0.0))
    alive = np.ones((n, c), bool)
    heads, ends = [], []
    for _ in range(min(degree, c)):
        rows = np.flatnonzero(alive.any(axis=1))
        if not len(rows):
            break
        pick = alive[rows].argmax(axis=1)
        chosen = at[rows, pick]
        heads.append(rows)
        ends.append(chosen)
        between = np.sqrt(np.maximum(2.0 - 2.0 * np.maximum(near[chosen[:, None], at[rows]], -1.0), 0.0))
        alive[rows] &= ~(alpha * between <= length[rows])
        alive[rows, pick] = False
    a, b = np.concatenate(heads), np.concatenate(ends)
    a, b = np.r_[a, b], np.r_[b, a]
    pairs = np.unique(a * n + b)
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def medoids(z: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Of each connected part of the graph the vector nearest to the part's mean."""
    groups = Groups(len(z))
    groups.add(np.repeat(np.arange(len(z)), [len(x) for x in lists]), np.concatenate(lists) if len(lists) else np.zeros(0, np.int64))
    out = []
    for head in np.unique(groups.label):
        part = np.flatnonzero(groups.label == head)
        out.append(part[np.argmax(z[part] @ z[part].mean(axis=0))])
    return np.array(out, dtype=np.int64)


class Graph:
    """A shard's unit vectors with their lists, and a count of the cosines that walks worked out."""

    def __init__(self, z: np.ndarray, lists: list[np.ndarray] | None = None, packed: tuple | None = None):
        self.z, self.cosines = z, 0
        if packed is None:
            lists = robust_prune(z) if lists is None else lists
            self.first = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            self.ends = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
            self.starts = medoids(z, lists)
        else:
            self.first, self.ends, self.starts = packed

    def in_range(self, q: np.ndarray, threshold: float, beam: int = BEAM, seeds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """(queries x vectors): True where the walk met a vector at or above the threshold.

        The walk starts at the medoids and at ``seeds`` (rows of queries, vectors).
        """
        n = len(self.z)
        near, waiting = np.full((len(q), n), -2.0), np.zeros((len(q), n), bool)
        row, node = np.repeat(np.arange(len(q)), len(self.starts)), np.tile(self.starts, len(q))
        if seeds is not None:
            row, node = np.r_[row, seeds[0]], np.r_[node, seeds[1]]
        key = np.unique(row * n + node)
        row, node = key // n, key % n
        while True:
            self.cosines += len(row)
            for lo in range(0, len(row), 1 << 17):
                r, v = row[lo:lo + (1 << 17)], node[lo:lo + (1 << 17)]
                near[r, v] = np.maximum((q[r] * self.z[v]).sum(axis=1), -1.0)
                waiting[r, v] = True
            # the beam's last place; everything in range is walked on from as well
            last = np.partition(near, n - beam, axis=1)[:, n - beam] if beam < n else np.full(len(q), -2.0)
            row, node = np.nonzero(waiting & (near >= np.minimum(last, threshold)[:, None]))
            if not len(row):
                return near >= threshold
            waiting[row, node] = False
            many = self.first[node + 1] - self.first[node]
            stop = np.cumsum(many)
            end = self.ends[np.arange(stop[-1]) - np.repeat(stop - many, many) + np.repeat(self.first[node], many)]
            fresh = np.zeros((len(q), n), bool)
            fresh[np.repeat(row, many), end] = True
            row, node = np.nonzero(fresh & (near == -2.0))


# --- over a table ------------------------------------------------------------

def entries(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, kind, x): each usable row with its components as they are; ``kind`` is the label and the number of
    components, as only vectors of one length are comparable."""
    numbers = F.transform(F.col("x"), lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", F.col(embedding).alias("x"), F.col("label").cast("string").alias("label"))
    rows = rows.filter(fine & F.exists("x", lambda v: v != 0))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("x", "label")).alias("r")).select("vec_id", "r.label", "r.x")
    return rows.select("vec_id", F.concat(F.size("x").cast("string"), F.lit(":"), "label").alias("kind"), "x")


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, in double precision, of a list column whose lists have one length."""
    return _normed(_flat(column), len(column))


def _normed(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centre_sample(equal: DataFrame, d: int, most: int, level: int) -> np.ndarray:
    """Up to ``most`` vectors of ``d`` components, by a hash of their id: any first few of them are a sample too."""
    rows = equal.filter(F.size("x") == d).orderBy(F.xxhash64(F.lit(SEED + level), "id"), "id").limit(most).select("x").toArrow()
    return _unit(rows["x"]) if rows.num_rows else np.zeros((0, d))


def _most_rows(d):
    return F.greatest(F.lit(2), F.least(F.lit(MOST_ROWS), F.floor(SHARD_VALUES / d)))


def deal(equal: DataFrame, overlap: int, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(shard, home, id, copies, x): every entry in its shards, ``home`` in one of them.

    Shards are numbers that follow from the kind and the centres. Sizes are joined, not collected.
    """
    members = equal.select(F.xxhash64("kind").alias("shard"), "kind", F.lit(True).alias("home"), "id", "copies", "x")
    d = equal.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = d["d"] if d else 1
    for level in range(LEVELS):
        sizes = store(members.groupBy("shard", "kind").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("x")).alias("d")).filter(
            F.col("n") > F.least(F.lit(most_rows), _most_rows(F.col("d")))).select("shard", "kind", F.ceil(F.col("n") / F.least(
                F.lit(shard_rows), _most_rows(F.col("d")))).alias("cells")), "sizes")
        most = sizes.agg(F.max("cells")).first()[0]
        if most is None:
            break
        centres = centre_sample(equal, d, min(most, MOST_CENTRES), level)

        def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = batch.column("cells").to_numpy(zero_copy_only=False)
                length = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    part = batch.filter(pa.array((cells == cell) & (length == d)))
                    some = centres[:int(cell)]
                    if not part.num_rows:
                        continue
                    near = _unit(part.column("x")) @ some.T
                    k = min(overlap, len(some))
                    order = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, 1), axis=1, kind="stable"), 1)
                    shard, home = part.column("shard").to_numpy().view(np.uint64), part.column("home").to_numpy(zero_copy_only=False)
                    for place in range(k):
                        to = mixed(shard + mixed(order[:, place].astype(np.uint64) + np.uint64(1000 * level + 1)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to.view(np.int64)), part.column("kind"), pa.array(home & (place == 0)), *(part.column(c) for c in ("id", "copies", "x"))],
                            names=["shard", "kind", "home", "id", "copies", "x"])
                rest = batch.filter(pa.array(length != d))
                if rest.num_rows:
                    yield rest.drop_columns(["cells"])

        large = members.join(sizes, ["shard", "kind"]).select(*members.columns, "cells")
        dealt = large.mapInArrow(around, members.schema)
        members = store(dealt.unionByName(members.join(sizes, ["shard", "kind"], "left_anti").select(*members.columns)), "members")
    # a dense place that centres do not part: as many splits by a hash as a vector has shards
    sizes = store(members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.min(F.least(F.lit(most_rows), _most_rows(F.size("x"))))).alias("parts")).filter("parts > 1"), "sizes")
    large = members.join(sizes, "shard")
    part = lambda k: F.xxhash64("shard", F.lit(k), F.pmod(F.xxhash64("id", F.lit(k)), F.col("parts")))
    twice = large.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("split"), part(k).alias("to")) for k in range(overlap)])).alias("s")).select(
        F.col("s.to").alias("shard"), "kind", (F.col("home") & (F.col("s.split") == 0)).alias("home"), "id", "copies", "x")
    return members.join(sizes.select("shard"), "shard", "left_anti").select(*members.columns).unionByName(twice)


_WALKED = "kind int, shard long, id long, links long, head long, seeds array<long>, cosines long, graph binary"
_GRAPH, _LINK, _SEND, _COUNT = 0, 1, 2, 3


def _rows(kind: int, n: int, **columns) -> pa.Table:
    types = {"shard": pa.int64(), "id": pa.int64(), "links": pa.int64(), "head": pa.int64(), "seeds": pa.list_(pa.int64()), "cosines": pa.int64(), "graph": pa.binary()}
    return pa.table({"kind": pa.array(np.full(n, kind, np.int32)), **{
        c: pa.nulls(n, t) if c not in columns else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t) for c, t in types.items()}})


def _walk(shard: int, graph: Graph, ids, copies, home, others, q, q_ids, seeds, threshold: float) -> list[pa.Table]:
    """Links, and where to send the queries next, of queries that walk a shard.

    A linked vector counts where it is at home; ``others`` are the other shards of each vector.
    """
    links, out = np.zeros(len(q), np.int64), []
    groups = Groups(len(ids) + len(q))
    where = {int(v): k for k, v in enumerate(ids)}
    own = np.array([where.get(int(v), len(ids) + k) for k, v in enumerate(q_ids)], np.int64)
    names = np.r_[ids, q_ids]
    linked_any = np.zeros(len(names), bool)
    send_q, send_to, send_seed = [], [], []
    counts = np.diff(others[0])
    for lo in range(0, len(q), 256):
        some = slice(lo, lo + 256)
        at = (seeds[0] >= lo) & (seeds[0] < lo + 256)
        met = graph.in_range(q[some], threshold, BEAM, (seeds[0][at] - lo, seeds[1][at]))
        row, node = np.nonzero(met)
        # on from every vector in range, the query itself among them, to its other shards
        many = counts[node]
        stop = np.cumsum(many)
        if len(stop) and stop[-1]:
            send_q.append(np.repeat(row + lo, many))
            send_to.append(others[1][np.arange(stop[-1]) - np.repeat(stop - many, many) + np.repeat(others[0][node], many)])
            send_seed.append(np.repeat(ids[node], many))
        other = ids[node] != q_ids[row + lo]
        row, node = row[other], node[other]
        links[some] = np.bincount(row, np.where(home[node], copies[node], 0), minlength=len(q[some]))
        for k in range(0, len(row), 1 << 18):
            groups.add(own[row[k:k + (1 << 18)] + lo], node[k:k + (1 << 18)])
        linked_any[own[row + lo]] = linked_any[node] = True
    some = np.flatnonzero(linked_any)
    heads = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(heads, groups.label, names)
    out.append(_rows(_LINK, len(some), id=names[some], links=np.zeros(len(some), np.int64), head=heads[groups.label[some]]))
    has = np.flatnonzero(links)
    out.append(_rows(_LINK, len(has), id=q_ids[has], links=links[has], head=q_ids[has]))
    if send_q:
        of, to, seed = (np.concatenate(c) for c in (send_q, send_to, send_seed))
        order = np.lexsort((seed, to, of))
        of, to, seed = of[order], to[order], seed[order]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (to[1:] != to[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(of)].astype(np.int32)), pa.array(seed))
        out.append(_rows(_SEND, len(new), id=q_ids[of[new]], shard=to[new], seeds=lists))
    out.append(_rows(_COUNT, 1, shard=[shard], cosines=[graph.cosines]))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], np.int64)
    return np.int64(len(arrays)).tobytes() + sizes.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    ends = 8 * (n + 1) + np.cumsum(sizes)
    return [data[end - size:end] for end, size in zip(ends, sizes)]


def audit(equal: DataFrame, links: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> float:
    """Recall of ``links(id, links)`` over a sample of ``equal(kind, x, id, copies)``: the share of exact links that it has.

    The sample is bounded and goes to every task; all vectors of its labels pass it in batches.
    """
    sample = equal.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(rows).select("id", "kind", "x").toArrow()
    if not sample.num_rows:
        return 1.0
    ids, kinds = sample["id"].to_numpy(), np.array(sample["kind"].to_pylist(), object)
    asked = {k: (ids[kinds == k], _unit(sample["x"].combine_chunks().take(pa.array(np.flatnonzero(kinds == k))))) for k in set(kinds)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column("kind").to_pylist(), object)
            for kind in set(own) & set(asked):
                part = batch.filter(pa.array(own == kind, pa.bool_()))
                q_ids, q = asked[kind]
                linked = (q @ _unit(part.column("x")).T >= threshold) & (q_ids[:, None] != part.column("id").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(np.where(linked, part.column("copies").to_numpy(), 0).sum(axis=1))], names=["id", "exact"])

    exact = equal.select("id", "kind", "x", "copies").mapInArrow(count, "id long, exact long").groupBy("id").agg(F.sum("exact").alias("exact"))
    found = F.least(F.coalesce("links", F.lit(0)), F.col("exact"))
    row = exact.join(links, "id", "left").agg(F.sum(found).alias("found"), F.sum("exact").alias("exact")).first()
    return row["found"] / row["exact"] if row["exact"] else 1.0


def walked(equal: DataFrame, threshold: float, overlap: int, shard_rows: int, most_rows: int) -> tuple[DataFrame, int]:
    """(id, links, head) over all walks, and the cosines that graphs and walks took."""
    members = store(deal(equal, overlap, shard_rows, most_rows), "members")
    numbers = members.select("shard", "id")
    shards_of = numbers.groupBy("id").agg(F.collect_list("shard").alias("all")).filter(F.size("all") > 1)  # a few for each vector
    elsewhere = numbers.join(shards_of, "id").select(F.col("shard").alias("of_shard"), F.col("id").alias("of"), F.array_except("all", F.array("shard")).alias("others"))

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        group, right = left.take(pc.sort_indices(left["id"])), right.take(pc.sort_indices(right["of"]))
        shard, z = group["shard"][0].as_py(), _unit(group["x"])
        ids, copies, home = group["id"].to_numpy(), group["copies"].to_numpy(), group["home"].to_numpy()
        many = np.zeros(len(ids), np.int64)
        many[np.searchsorted(ids, right["of"].to_numpy())] = right["others"].combine_chunks().value_lengths().to_numpy()
        others = np.r_[0, np.cumsum(many)], _flat(right["others"]).astype(np.int64)
        graph = Graph(z)
        x = _flat(group["x"])
        packed = _pack(ids, copies, home.astype(np.uint8), *others, graph.first, graph.ends, graph.starts, np.frombuffer(x.dtype.str.encode(), np.uint8), x)
        graph.cosines = len(z) * (len(z) - 1) // 2
        every = np.arange(len(ids))
        return pa.concat_tables([_rows(_GRAPH, 1, shard=[shard], graph=[packed]), *_walk(shard, graph, ids, copies, home, others, z, ids, (every, every), threshold)])

    done = store(members.groupBy("shard").cogroup(elsewhere.groupBy("of_shard")).applyInArrow(build, _WALKED), "walks")
    graphs = done.filter(F.col("kind") == _GRAPH).select("shard", "graph")
    walks, visited = done, members.select("id", "shard")

    def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _rows(_LINK, 0)
        shard = left["shard"][0].as_py()
        raw = _unpack(left["graph"][0].as_py())
        ids, copies, home, *others = (np.frombuffer(b, t) for b, t in zip(raw, (np.int64, np.int64, np.uint8, np.int64, np.int64)))
        z = _normed(np.frombuffer(raw[9], np.dtype(raw[8].decode())), len(ids))
        graph = Graph(z, packed=tuple(np.frombuffer(b, np.int64) for b in raw[5:8]))
        lists = right["seeds"].combine_chunks()
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        seeds = np.searchsorted(ids, lists.flatten().to_numpy())
        return pa.concat_tables(_walk(shard, graph, ids, copies, home.astype(bool), tuple(others), _unit(right["x"]), right["id"].to_numpy(), (of, seeds), threshold))

    while True:
        sent = done.filter(F.col("kind") == _SEND).groupBy("id", "shard").agg(F.array_distinct(F.flatten(F.collect_list("seeds"))).alias("seeds"))
        sent = store(sent.join(visited, ["id", "shard"], "left_anti"), "sent")
        if sent.isEmpty():
            break
        visited = store(visited.unionByName(sent.select("id", "shard")), "visited")
        # a shard with many queries meets them in blocks
        blocks = store(sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
        asking = (sent.join(equal.select("id", "x"), "id").join(blocks, "shard")
                  .withColumn("q_block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumnRenamed("shard", "q_shard").drop("blocks"))
        asked = graphs.join(blocks, "shard").select("shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        done = store(asked.groupBy("shard", "block").cogroup(asking.groupBy("q_shard", "q_block")).applyInArrow(go_on, _WALKED), "walks")
        walks = walks.unionByName(done)
    found = walks.filter(F.col("kind") == _LINK).select("id", "links", "head")
    return found, walks.filter(F.col("kind") == _COUNT).agg(F.sum("cosines")).first()[0] or 0


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS,
                overlap: int = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) with one row for each id of ``vectors(vec_id, embedding, label)``.

    Vectors link if their labels are equal and their cosine is at least ``threshold``. Vectors that are
    null, zero, or hold null or non-finite components, and rows without a label, link with nothing, as do
    vectors of different lengths. Of a repeated id the smallest vector counts; rows without an id are one row
    without links and component. An empty table gives an empty result; other columns are not looked at.
    """
    rows = store(entries(vectors), "vectors")
    # equal vectors of a label are one entry
    equal = store(rows.groupBy("kind", "x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "equal")
    while True:
        found, _ = walked(equal, threshold, overlap, shard_rows, most_rows)
        links = store(found.groupBy("id").agg(F.sum("links").alias("links")), "links")
        recall = audit(equal, links, threshold)
        if recall >= RECALL:
            break
        if overlap >= MOST_OVERLAP:
            raise RuntimeError(f"the audit found {recall:.4f} of the links of a sample, less than {RECALL}")
        overlap += 2
    components = connected(found.filter("id <> head").select("id", "head"), "id", "head").withColumnRenamed("node", "id")
    # only copies have to look for their entry; the others are one themselves
    several = store(equal.filter("copies > 1").select(F.col("kind").alias("__kind"), F.col("x").alias("__x"), "id", "copies"), "several")
    named = rows.join(several, (F.col("kind") == F.col("__kind")) & (F.col("x") == F.col("__x")), "left").select(
        "vec_id", F.coalesce("id", "vec_id").alias("id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    placed = named.join(links, "id", "left").join(components, "id", "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return (vectors.select("vec_id").distinct().join(placed, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
                    (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept")))
