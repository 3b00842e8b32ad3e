"""Language-model scores of documents by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts, up to ``ORDER`` bytes long, with the counts of the bytes that
followed each in the training documents. A byte is predicted from the longest known context. If it never
followed there, an escape is coded, with probability (distinct successors) / (successors + distinct
successors), and the context one byte shorter is asked, without the bytes that the longer one has already
ruled out; at last all bytes that are left are equally likely. The code length of a document is the
sum over its bytes and its end.

The trie is never in one place. Each block of documents counts its own paths and words and packs them into
one row for each of ``BUCKETS`` buckets: the bucket of a path is a hash of the last two bytes of its
context, so that all contexts of two bytes and more that a prediction can fall back through share a bucket
(contexts of one byte and none are a table of at most 65,792 rows, which every task gets). A bucket with many
keys is divided into parts by the byte before those two; then its contexts of two bytes, at most 65,536
counts, are summed apart and go with every part. Parts are summed over a few blocks at a time, level by level,
and turned into log probabilities. The blocks' questions stream past the part that they are about, sorted behind
it; where there are so many that one task should not see them all, the part is there as often as their bytes
ask for. The answers go back to the blocks, whose documents are scored against them.

Keys travel sorted, as differences in byte planes, compressed.

A base model of single words is scored along the way, with add-one smoothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from eventspark.llm.common import is_held_out
from eventspark.scratch import store

ORDER = 5
END = 0xFF            # never occurs in UTF-8
PIECE_BYTES = 2 << 20   # text that is counted or scored at a time
BLOCK_BYTES = 16 << 20  # of text in a block
BUCKETS = 256           # of paths, and of words
PART_KEYS = 2 << 20     # of a bucket, counted in every block, before it is divided
MOST_PARTS = 256
MERGED_KEYS = 8 << 20   # that are summed at once
FAN_IN = 8              # sums of a part that are added up at once
ASKED_KEYS = 128 << 20  # that stream past one copy of a part
PATH, WORD = 0, 1
_ROW = "block long, kind int, bucket int, size long, keys binary, n binary"
_BYTE = np.uint64(8)


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def paths(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Context and next byte of each byte and end of the texts, packed; where each text begins among them.

    Before the first byte of a text the context is filled with zero bytes.
    """
    pad = b"\0" * order
    data = np.frombuffer(b"".join(part for t in texts for part in (pad, t, b"\xff")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    real = np.ones(len(data), bool)
    begins = np.cumsum(sizes + order) - sizes - order
    real[(begins[:, None] + np.arange(order)).ravel()] = False
    packed = np.zeros(max(len(data) - order, 0), np.uint64)
    for k in range(order + 1):
        packed |= data[k:len(data) - order + k].astype(np.uint64) << np.uint64(8 * (order - k))
    return packed[real[order:]], np.cumsum(sizes) - sizes


def _keep(order: int) -> np.uint64:
    """Mask of a path of that order: its context bytes and the next byte."""
    return np.uint64((1 << 8 * (order + 1)) - 1)


class Level:
    """Counts of one order over some paths, by path and by context."""

    def __init__(self, path: np.ndarray, count: np.ndarray, order: int):
        self.path, at = np.unique(path & _keep(order), return_inverse=True)
        self.count = np.bincount(at, count, minlength=len(self.path)).astype(np.int64)
        known = self.count > 0
        self.context, place = np.unique(self.path >> _BYTE, return_inverse=True)
        self.total = np.bincount(place, self.count, minlength=len(self.context)).astype(np.int64)
        self.distinct = np.bincount(place, known, minlength=len(self.context)).astype(np.int64)
        self.place, self.known = place, known

    def exclude_from(self, shorter: Level, order: int) -> None:
        """For each context, what its successors count one order below."""
        below = shorter.of(self.path & _keep(order - 1))[0]
        self.ruled_out = np.bincount(self.place, np.where(self.known, below, 0), minlength=len(self.context)).astype(np.int64)

    def of(self, path: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count of each path, and total, distinct successors and exclusions of its context."""
        def find(keys, wanted, *values):
            if not len(keys):
                return [np.zeros(len(wanted), np.int64) for _ in values]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = keys[at] == wanted
            return [np.where(same, v[at], 0) for v in values]

        ruled_out = getattr(self, "ruled_out", np.zeros(len(self.context), np.int64))
        return (*find(self.path, path, self.count), *find(self.context, path >> _BYTE, self.total, self.distinct, ruled_out))


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_numbers(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n or 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def pack_keys(path: np.ndarray) -> bytes:
    """Ascending paths."""
    return pack_numbers(np.diff(path, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n")


def low_levels(path: np.ndarray, count: np.ndarray) -> tuple[Level, Level]:
    """Orders 0 and 1 from paths of order 1."""
    zero, one = Level(path, count, 0), Level(path, count, 1)
    one.exclude_from(zero, 1)
    return zero, one


def log_probabilities(path: np.ndarray, count: np.ndarray, low: tuple[Level, Level], order: int = ORDER,
                      second: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 of the probability of each path's last byte, for all paths that share their last two context bytes.

    If they are not all here, but all with the same three context bytes, ``second`` has paths of order 2 with their counts.
    """
    levels = {0: low[0], 1: low[1]}
    for k in range(2, order + 1):
        levels[k] = Level(*second, k) if k == 2 and second is not None else Level(path, count, k)
        levels[k].exclude_from(levels[k - 1], k)
    out, open_ = np.zeros(len(path)), np.ones(len(path), bool)
    gone, gone_n = np.zeros(len(path), np.int64), np.zeros(len(path), np.int64)  # ruled out: counts, bytes
    for k in range(order, -1, -1):
        hits, total, distinct, ruled_out = levels[k].of(path & _keep(k))
        seen = open_ & (total > 0)
        rest, new = total - gone, distinct - gone_n
        able = seen & (rest > 0)
        hit, miss = able & (hits > 0), able & (hits == 0)
        whole = np.maximum(rest + new, 1)
        out[hit] += np.log10(hits[hit] / whole[hit])
        out[miss] += np.log10(new[miss] / whole[miss])
        open_ &= ~hit
        left = seen & ~hit
        gone, gone_n = np.where(left, ruled_out, gone), np.where(left, distinct, gone_n)
    out[open_] -= np.log10(256 - gone_n[open_])
    return out


# --- over a table ------------------------------------------------------------

def _buckets_of(path: np.ndarray) -> np.ndarray:
    last_two = (path >> _BYTE) & np.uint64(0xFFFF)
    return ((last_two * np.uint64(2654435761) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def _pack(block: int, path: np.ndarray, n: np.ndarray, words: dict[bytes, int]) -> pa.RecordBatch:
    """A row for each bucket with its sorted keys and their counts. Words hold no white space."""
    rows: list[tuple] = []
    bucket = _buckets_of(path)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        some = order[cuts[k]:cuts[k + 1]]
        rows.append((block, PATH, int(k), len(some), pack_keys(path[some]), pack_numbers(n[some])))
    of: list[list[bytes]] = [[] for _ in range(BUCKETS)]
    for w in words:
        of[crc32(w) % BUCKETS].append(w)
    for k, some in enumerate(of):
        if some:
            some.sort()
            rows.append((block, WORD, k, len(some), pack_words(some), pack_numbers(np.array([words[w] for w in some]))))
    columns = list(zip(*rows)) or [[]] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["block", "kind", "bucket", "size", "keys", "n"])


class BlockCounts:
    """Paths and words of one block: counts in training texts, and what occurs in other texts."""

    def __init__(self, block: int):
        self.block, self.size = block, 0
        self.texts: tuple[list[bytes], list[bytes]] = ([], [])
        self.path, self.n, self.other = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.words: Counter = Counter()
        self.other_words: set[bytes] = set()

    def add(self, held_out: bool, text: bytes) -> None:
        self.texts[held_out].append(text)
        self.size += len(text)
        if self.size >= PIECE_BYTES:
            self.merge()

    def merge(self) -> None:
        learned, other = self.texts
        if learned:
            path, n = np.unique(paths(learned)[0], return_counts=True)
            both, at = np.unique(np.r_[self.path, path], return_inverse=True)
            self.n = np.bincount(at, np.r_[self.n, n], minlength=len(both)).astype(np.int64)
            self.path = both
            self.words.update(b"\n".join(learned).lower().split())
        if other:
            self.other = np.union1d(self.other, paths(other)[0])
            self.other_words.update(b"\n".join(other).lower().split())
        self.texts, self.size = ([], []), 0

    def rows(self) -> pa.RecordBatch:
        """All counts, 0 for what occurs in other texts only."""
        self.merge()
        more = np.setdiff1d(self.other, self.path)
        path, order = np.r_[self.path, more], np.argsort(np.r_[self.path, more], kind="stable")
        self.words.update(dict.fromkeys(self.other_words, 0))  # adds nothing to known words
        return _pack(self.block, path[order], np.r_[self.n, np.zeros(len(more), np.int64)][order], self.words)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: BlockCounts | None = None
    for batch in batches:
        for block, held_out, text in zip(*(batch.column(c).to_pylist() for c in ("block", "held_out", "text"))):
            if now is None or now.block != block:
                if now is not None:
                    yield now.rows()
                now = BlockCounts(block)
            now.add(held_out, text_bytes(text))
    if now is not None:
        yield now.rows()


def _part_of(kind: int, keys: np.ndarray | list[bytes], parts: int) -> np.ndarray:
    """Part of a bucket that each key belongs to: by the third last byte of a path's context, or by the word."""
    if kind == WORD:
        return np.array([crc32(w) // BUCKETS % parts for w in keys], np.int64)
    third = (keys >> np.uint64(24)) & np.uint64(0xFF)
    return ((third * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(parts)).astype(np.int64)


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of divided buckets as a row for each part."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            words = row["kind"] == WORD
            keys, n = (unpack_words if words else unpack_keys)(row["keys"]), unpack_numbers(row["n"])
            part = _part_of(row["kind"], keys, row["parts"])
            for k in np.unique(part):
                some = np.flatnonzero(part == k)
                packed = pack_words([keys[i] for i in some]) if words else pack_keys(keys[some])
                rows.append(row | {"part": int(k), "size": len(some), "keys": packed, "n": pack_numbers(n[some])})
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def _merge(group: pa.Table) -> pa.Table:
    """Sums of one part of a bucket over some blocks."""
    kind, counts = group["kind"][0].as_py(), [unpack_numbers(x) for x in group["n"].to_pylist()]
    if kind == PATH:
        keys, at = np.unique(np.concatenate([unpack_keys(x) for x in group["keys"].to_pylist()]), return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, at, np.concatenate(counts))
        packed = pack_keys(keys)
    else:
        sums: dict[bytes, int] = {}
        for words, n in zip(group["keys"].to_pylist(), counts):
            for w, k in zip(unpack_words(words), n.tolist()):
                sums[w] = sums.get(w, 0) + k
        words = sorted(sums)
        total, packed = np.array([sums[w] for w in words], np.uint64), pack_words(words)
    return pa.table({**{c: group[c][:1] for c in ("kind", "bucket", "part", "groups", "group")},
                     "keys": pa.array([packed], pa.binary()), "n": pa.array([pack_numbers(total)], pa.binary())})


def _by_last_bytes(path: np.ndarray, n: np.ndarray, bytes_: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last bytes of paths."""
    last, at = np.unique(path & np.uint64((1 << 8 * bytes_) - 1), return_inverse=True)
    total = np.zeros(len(last), np.int64)
    np.add.at(total, at, n)
    return last, total


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the last two bytes of paths; sum of the words' counts (0) and number of words counted (1)."""
    for batch in batches:
        for kind, keys, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "n"))):
            n = unpack_numbers(n).astype(np.int64)
            if kind == PATH:
                path, total = _by_last_bytes(unpack_keys(keys), n, 2)
            else:
                path, total = np.arange(2, dtype=np.uint64), np.array([n.sum(), (n > 0).sum()])
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(total), pa.array(np.full(len(path), kind, np.int64))],
                                             names=["path", "n", "kind"])


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part of a bucket the counts of the last three bytes of its paths."""
    for batch in batches:
        found = [_by_last_bytes(unpack_keys(keys), unpack_numbers(n).astype(np.int64), 3) for keys, n in zip(*(batch.column(c).to_pylist() for c in ("keys", "n")))]
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array([pack_keys(k) for k, _ in found], pa.binary()),
                                          pa.array([pack_numbers(n) for _, n in found], pa.binary())], names=["bucket", "keys2", "n2"])


def _whole_second(group: pa.Table) -> pa.Table:
    """Added up over the parts of a bucket: at most 65,536 counts for each of its few pairs of bytes."""
    path, n = (np.concatenate([f(x) for x in group[c].to_pylist()]) for c, f in (("keys2", unpack_keys), ("n2", unpack_numbers)))
    path, n = _by_last_bytes(path, n.astype(np.int64), 3)
    return pa.table({"bucket": group["bucket"][:1], "keys2": pa.array([pack_keys(path)], pa.binary()), "n2": pa.array([pack_numbers(n)], pa.binary())})


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part, then the questions about it: the values of the keys that a block asked for."""
    kind, known, value = None, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["block"] is None:
                kind = row["kind"]
                if kind == PATH:
                    known, value = unpack_keys(row["keys"]), np.frombuffer(row["value"], "<f4")
                else:
                    known, value = {w: k for k, w in enumerate(unpack_words(row["keys"]))}, np.frombuffer(row["value"], "<f8")
                continue
            if kind == PATH:
                found = values_at(known, unpack_keys(row["keys"]), value)
            else:
                found = value[np.fromiter(map(known.__getitem__, unpack_words(row["keys"])), np.int64)]
            out.append((row["block"], kind, row["keys"], found.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                             names=["block", "kind", "keys", "value"])


def values_at(known: np.ndarray, wanted: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of the wanted keys among the sorted known ones; a key that is missing is an error."""
    at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
    if len(wanted) and (not len(known) or not (known[at] == wanted).all()):
        raise RuntimeError("a path was scored that its block had not counted")
    return value[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task by blocks of at most about ``BLOCK_BYTES`` of text."""
    first, done = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        upto = done + np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        block = first + np.r_[done, upto[:-1]] // BLOCK_BYTES
        done = int(upto[-1]) if len(upto) else done
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block[:batch.num_rows])], names=[*batch.schema.names, "block"])


def with_block(docs: DataFrame) -> DataFrame:
    """Write ``docs`` with a column ``block``, a run of rows of one task.

    Texts are counted and scored from the written table: which rows a task reads changes with the cores and
    executors there are, and the block of a row must not.
    """
    rows = docs.select("doc_id", "text", is_held_out(7, 2).alias("held_out"))
    schema = StructType([*rows.schema.fields, StructField("block", LongType())])
    return store(rows.mapInArrow(_blocks, schema), "texts", compression="zstd")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``score`` is the log10 probability of the whole text and its end under PPM, ``base_score`` that of its
    words under the base model. Documents of fold 2 of crc32 modulo 7, and those without an id, are scored
    and not learned from. A null text counts as empty. Repeated rows are learned from and scored as often
    as they occur. Without any training document all bytes are equally likely; an empty table gives an
    empty result.
    """
    blocks = with_block(docs)
    counts = store(blocks.select("block", "held_out", "text").mapInArrow(_counts, _ROW), "counts")
    # for each of the buckets: parts, groups of blocks that are summed first, and copies that questions need
    sizes = counts.groupBy("kind", "bucket").agg(F.sum("size").alias("size"))
    up = lambda c, n: F.greatest(F.lit(1), F.ceil(c / n)).cast("int")
    plan = sizes.withColumn("parts", F.least(F.lit(MOST_PARTS), up(F.col("size"), PART_KEYS)))
    plan = store(plan.select("kind", "bucket", "parts", up(F.col("size") / F.col("parts"), MERGED_KEYS).alias("groups"),
                             up(F.col("size") / F.col("parts"), ASKED_KEYS).alias("copies")), "plan")  # a row for a bucket
    placed = counts.join(F.broadcast(plan), ["kind", "bucket"]).withColumn("part", F.lit(0))
    divided = placed.filter("parts > 1")
    placed = placed.filter("parts = 1").unionByName(divided.mapInArrow(_divided, divided.schema))
    merged = placed.select("kind", "bucket", "part", "groups", F.pmod(F.xxhash64("block"), "groups").cast("int").alias("group"), "keys", "n")
    left = plan.agg(F.max("groups")).first()[0] or 1
    while True:
        merged = store(merged.groupBy("kind", "bucket", "part", "groups", "group").applyInArrow(
            _merge, "kind int, bucket int, part int, groups int, group int, keys binary, n binary"), "merged")
        if left == 1:
            break
        left = -(-left // FAN_IN)
        fewer = F.ceil(F.col("groups") / FAN_IN).cast("int")
        merged = merged.select("kind", "bucket", "part", fewer.alias("groups"), F.pmod("group", fewer).alias("group"), "keys", "n")

    small = merged.mapInArrow(_summaries, "path long, n long, kind long").groupBy("kind", "path").agg(F.sum("n").alias("n"))
    small = small.toPandas()  # two bytes of a path, and the totals of the words
    low = small[small["kind"] == PATH].sort_values("path")
    low = low_levels(low["path"].to_numpy(np.int64).view(np.uint64), low["n"].to_numpy(np.int64))
    totals = dict(small[small["kind"] == WORD][["path", "n"]].itertuples(index=False))
    learned_docs = blocks.filter(~F.col("held_out")).count()
    n, v = int(totals.get(0, 0)) + learned_docs, int(totals.get(1, 0)) + (learned_docs > 0)
    base_of = lambda count: np.log10((count + 1) / (n + v + 1))
    base_end = float(base_of(learned_docs))
    rare = base_of(0.5)  # below it are words that no training document has

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for kind, keys, count, keys2, n2 in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "n", "keys2", "n2"))):
                count = unpack_numbers(count).astype(np.int64)
                if kind == PATH:
                    second = None if keys2 is None else (unpack_keys(keys2), unpack_numbers(n2).astype(np.int64))
                    values.append(log_probabilities(unpack_keys(keys), count, low, second=second).astype("<f4").tobytes())
                else:
                    values.append(base_of(count).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "bucket", "part", "keys")), pa.array(values, pa.binary())],
                                             names=["kind", "bucket", "part", "keys", "value"])

    several = merged.join(F.broadcast(plan.filter((F.col("kind") == PATH) & (F.col("parts") > 1)).select("kind", "bucket")), ["kind", "bucket"])
    second = store(several.select("bucket", "keys", "n").mapInArrow(_second, "bucket int, keys2 binary, n2 binary").groupBy("bucket").applyInArrow(
        _whole_second, "bucket int, keys2 binary, n2 binary"), "second").withColumn("kind", F.lit(PATH))
    model = merged.select("kind", "bucket", "part", "keys", "n").join(second, ["kind", "bucket"], "left")
    model = store(model.mapInArrow(predict, "kind int, bucket int, part int, keys binary, value binary"), "model")
    copied = model.join(F.broadcast(plan), ["kind", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    about = ["kind", "bucket", "part", "copy"]
    asked = placed.select("kind", "bucket", "part", F.pmod(F.xxhash64("block"), "copies").cast("int").alias("copy"), "block", "keys", F.lit(None).cast("binary").alias("value"))
    parts = copied.select(*about, F.lit(None).cast("long").alias("block"), "keys", "value")
    answers = (parts.unionByName(asked).repartition(*about).sortWithinPartitions(*about, F.col("block").asc_nulls_first())
               .mapInArrow(_answers, "block long, kind int, keys binary, value binary"))

    def score_block(left: pa.Table, right: pa.Table) -> pa.Table:
        path, log_p, of_word = [np.zeros(0, np.uint64)], [np.zeros(0)], {}
        for kind, keys, value in zip(right["kind"].to_pylist(), right["keys"], right["value"]):
            keys, value = keys.as_py(), value.as_buffer()
            if kind == PATH:
                path.append(unpack_keys(keys))
                log_p.append(np.frombuffer(value, "<f4"))
            else:
                of_word.update(zip(unpack_words(keys), np.frombuffer(value, "<f8").tolist()))
        path, log_p = np.concatenate(path), np.concatenate(log_p)
        order = np.argsort(path)
        path, log_p = path[order], log_p[order].astype(np.float64)
        n_tokens, n_known, base, own = [], [], [], []
        texts: list[bytes] = []

        def finish():
            found, begins = paths(texts)
            own.append(np.add.reduceat(values_at(path, found, log_p), begins))
            texts.clear()

        size = 0
        for text, held_out in zip(left["text"], left["held_out"].to_pylist()):
            data = text_bytes(text.as_py())
            words = data.lower().split()
            found = list(map(of_word.__getitem__, words))
            n_tokens.append(len(words) + 1)
            n_known.append(len(words) + (learned_docs > 0) - (sum(x < rare for x in found) if held_out else 0))
            base.append(sum(found) + base_end)
            texts.append(data)
            size += len(data)
            if size >= PIECE_BYTES:
                finish()
                size = 0
        if texts:
            finish()
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array(n_tokens, pa.int64()),
                         "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(base), pa.int64()),
                         "base_score": pa.array(base, pa.float64()), "score": pa.array(np.concatenate(own))})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score_block, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
