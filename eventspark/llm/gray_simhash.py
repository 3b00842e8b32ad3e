"""SimHash near copies by a hierarchical index over fingerprints in Gray order.

A document's fingerprint has 64 bits: each is the majority of that bit over the XXH64 values (seed 42) of
its three-word shingles, repeats included. Fingerprints that differ in at most ``max_bits`` bits link.

Distinct fingerprints are indexed, not documents, so a group of exact copies is one entry. The index is a
hierarchy of masked bit patterns. Its upper nodes are the patterns of one block of bits out of
``max_bits + 1``: fingerprints within ``max_bits`` agree on at least one block, so every link lies below
some upper node, and Spark deals these nodes out by their pattern. An upper node with too many
fingerprints is divided again over blocks of its other bits, until at most 20 bits are free: no node
outgrows a task, whatever the data. Below an upper node, fingerprints are sorted by Gray rank and every
eight neighbours form a node that holds the bits they share; a search walks down with the differences
accumulated so far and drops a whole node once they exceed ``max_bits``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.components import connected
from eventspark.scratch import store

FAN = 8                    # children of a node of the index
NODE_FINGERPRINTS = 50_000  # an upper node with more is divided again
TASK_ROWS = 200_000
PAIRS_AT_ONCE = 2_000_000
SEED, SHINGLE = 42, 3


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest, n = xxhash.xxh64_intdigest, len(shingles)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(s, SEED) for s in shingles[at:at + (1 << 15)]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, column: str = "__fp") -> DataFrame:
    """Add the fingerprint as a signed 64-bit integer. One projection, no shuffle."""
    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            yield pd.Series(values.view(np.int64))

    return docs.withColumn(column, fingerprints(F.col("text")))


# --- the index inside a task --------------------------------------------------

def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each 64-bit value in the reflected Gray sequence."""
    out = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A forest: one tree of masked patterns for each upper node, over fingerprints in Gray order."""

    def __init__(self, tree: np.ndarray, bits: np.ndarray):
        order = np.lexsort((gray_rank(bits), tree))
        self.order, self.bits = order, bits[order]
        tree = tree[order]
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        # level 0 holds the fingerprints; a node of level l + 1 spans children first[i] .. first[i + 1]
        value, mask, owner = self.bits, np.full(len(bits), ones), tree
        self.levels = [(value, mask, None)]
        while len(owner) and (owner[1:] == owner[:-1]).any():
            n = len(owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
            first = np.flatnonzero(place % FAN == 0)
            same = np.bitwise_and.reduceat(value & mask, first)
            some = np.bitwise_or.reduceat(value & mask, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(same ^ some)
            value, mask, owner = same & shared, shared, owner[first]
            self.levels.append((value, mask, np.r_[first, n]))
        # the top node of each fingerprint's tree
        self.root = np.repeat(np.arange(len(owner)), np.diff(np.r_[np.flatnonzero(
            np.r_[True, tree[1:] != tree[:-1]]), len(tree)])) if len(tree) else np.zeros(0, np.int64)

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in ``order``) of one tree that differ in at most ``max_bits`` bits, in pieces."""
        n = len(self.bits)
        size = np.bincount(self.root, minlength=1)[self.root] if n else np.zeros(0, np.int64)
        piece = np.cumsum(np.minimum(size, n)) // PAIRS_AT_ONCE
        for lo, hi in zip(*_runs(piece)):
            query = np.arange(lo, hi)
            node, acc = self.root[lo:hi], np.zeros(hi - lo, np.int64)
            seen = None
            for level in range(len(self.levels) - 1, -1, -1):
                value, mask, _ = self.levels[level]
                # only bits that the parent did not compare yet
                fresh = mask[node] if seen is None else mask[node] & ~seen
                acc = acc + np.bitwise_count((self.bits[query] ^ value[node]) & fresh)
                keep = acc <= max_bits
                query, node, acc = query[keep], node[keep], acc[keep]
                if level == 0:
                    break
                first = self.levels[level][2]
                many = first[node + 1] - first[node]
                seen = np.repeat(mask[node], many)
                query, acc = np.repeat(query, many), np.repeat(acc, many)
                ends = np.cumsum(many)
                node = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many) + np.repeat(first[node], many)
            later = query < node
            yield query[later], node[later]


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(values):
        return [], []
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts.tolist(), np.r_[starts[1:], len(values)].tolist()


class Groups:
    """Smallest member of each group of linked places, kept up while links arrive."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low = np.minimum(la, lb)
            np.minimum.at(self.label, la, low)
            np.minimum.at(self.label, lb, low)
            while True:
                next_ = self.label[self.label]
                if (next_ == self.label).all():
                    break
                self.label = next_


def linked_to(tree: np.ndarray, bits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that links with others, beside one member of its group: linear in the rows."""
    index = GrayIndex(tree, bits)
    groups = Groups(len(bits))
    for a, b in index.links(max_bits):
        groups.add(a, b)
    moved = np.flatnonzero(groups.label != np.arange(len(bits)))
    return index.bits[moved], index.bits[groups.label[moved]]


# --- over a table ------------------------------------------------------------

def _blocks(bits: tuple[int, ...], parts: int) -> list[tuple[int, ...]]:
    size, more = divmod(len(bits), parts)
    out, at = [], 0
    for k in range(parts):
        out.append(bits[at:at + size + (k < more)])
        at += size + (k < more)
    return out


def _mask(bits: tuple[int, ...]) -> int:
    word = sum(1 << b for b in bits)
    return word - (1 << 64) if word >> 63 else word


def upper_nodes(prints: DataFrame, max_bits: int, node_fingerprints: int = NODE_FINGERPRINTS) -> DataFrame:
    """(fp, node string): the upper nodes a fingerprint belongs to, none above ``node_fingerprints``
    unless at most 20 of its bits are free."""
    open_, done = [(prints.select("fp", F.lit("").alias("node")), tuple(range(64)), "")], []
    while open_:
        rows, bits, path = open_.pop()
        blocks = _blocks(bits, max_bits + 1)
        kids = [F.struct(F.lit(f"{path}{k}").alias("path"),
                         F.concat_ws("/", "node", F.concat(F.lit(f"{k}:"), F.hex(F.col("fp").bitwiseAND(F.lit(_mask(b)))))).alias("node"))
                for k, b in enumerate(blocks)]
        placed = store(rows.select("fp", F.explode(F.array(*kids)).alias("kid")).select("fp", "kid.path", "kid.node"), "nodes")
        big = placed.groupBy("path", "node").count().filter(F.col("count") > node_fingerprints)
        big = store(big, "bignodes")
        paths = {r[0] for r in big.select("path").distinct().collect()}  # at most max_bits + 1
        if not paths:
            done.append(placed.select("fp", "node"))
            continue
        done.append(placed.join(big, ["path", "node"], "left_anti").select("fp", "node"))
        for k, block in enumerate(blocks):
            if f"{path}{k}" in paths:
                rest = tuple(b for b in bits if b not in block)
                hot = placed.filter(F.col("path") == f"{path}{k}").join(big, ["path", "node"], "left_semi").select("fp", "node")
                if len(rest) <= 20:
                    done.append(hot)
                else:
                    open_.append((hot, rest, f"{path}{k}"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fingerprint_components(prints: DataFrame, max_bits: int = 2,
                           node_fingerprints: int = NODE_FINGERPRINTS) -> DataFrame:
    """(fp, head) for distinct fingerprints ``prints(fp)``: head names the group; single ones are absent."""
    nodes = upper_nodes(prints, max_bits, node_fingerprints)
    n = nodes.count()
    tasks = max(1, -(-n // TASK_ROWS))
    tasks = max(tasks, min(n // 1000, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            names = rows["node"].combine_chunks().dictionary_encode()
            bits = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
            a, b = linked_to(names.indices.to_numpy().astype(np.int64), bits, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    edges = nodes.repartition(tasks, "node").mapInArrow(search, "a long, b long")
    return connected(edges, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("head"))


def near_copies(docs: DataFrame, max_bits: int = 2, node_fingerprints: int = NODE_FINGERPRINTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    The component is the smallest id reachable by links; null ids are ignored for it unless a group has no
    other. Null and empty texts have fingerprint zero and link like any other; repeated rows are kept, as
    rows of one group. An empty table gives an empty result; other columns are ignored.
    """
    rows = store(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "fingerprints")
    prints = store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    heads = fingerprint_components(prints.select("fp"), max_bits, node_fingerprints)
    placed = prints.join(heads, "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    least = placed.groupBy("head").agg(F.min("least").alias("component_id"))
    by_print = placed.join(least, "head").select("fp", "component_id")
    return rows.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id.

    Of repeated rows of an id one stays. Rows without an id stay only if their group has no id, one of them. Null and
    empty texts are near copies of each other. All columns pass unchanged, whatever their names; an empty table stays
    empty.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                     F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = store(with_fingerprint(docs.select("doc_id", "text"), "fp").select(order.alias("key"), "fp"), "fingerprints")
    prints = store(rows.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    heads = fingerprint_components(prints.select("fp"), max_bits)
    kept = (prints.join(heads, "fp", "left").groupBy(F.coalesce("head", "fp").alias("head"))
            .agg(F.min("least").alias("key"))
            .select(F.coalesce("key.id", F.lit(0)).alias("__near_id"), F.col("key.no_id").alias("__near_no_id"),
                    F.col("key.text_hash").alias("__near_hash")))
    keyed = docs.select(F.struct(*docs.columns).alias("__near_row"), F.coalesce("doc_id", F.lit(0)).alias("__near_id"),
                        F.col("doc_id").isNull().alias("__near_no_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__near_hash"))
    return (keyed.join(kept, ["__near_id", "__near_no_id", "__near_hash"], "left_semi")
            .dropDuplicates(["__near_id", "__near_no_id", "__near_hash"]).select("__near_row.*"))
