"""Token ids in Parquet files that can be read in parts.

A row is a document: its id, the number of its tokens, its place in the stream of all tokens and the ids,
a list column. Ids are delta encoded (or by dictionary), row groups and pages have a set size, and the
writer adds page indexes. Documents lie in ascending order of their id, so a range of ids touches few row
groups and, through the page index, few pages of them; the other columns are read without any token.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventspark.llm.common import texts_at_once
from eventspark.scratch import scratch_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
MEMO_CHUNKS = 1_200_000
BATCH_BYTES = 4 << 20


class _Memo(dict):
    """Ids of chunks, encoded when they are first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.encode(chunk)
        return ids


# The published pattern of byte-level tokenizers and the characters that stand for bytes.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STANDS_FOR = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
# characters that both pattern engines classify alike
_COMMON = re.compile("[\n\x20-\x7e\xa1-\u024f]*")


# Class of a byte: a letter's later byte is a letter; of C2 and what follows it, and of the signs among the letters of C3, the
# pattern's class is left open. Bytes of no common character are rare: what stands beside one is not cut from it.
_SPACE, _LETTER, _DIGIT, _SIGN, _OPEN, _RARE, _QUOTE, _LINE = range(8)
_CLASS = np.full(256, _RARE, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
_CLASS[48:58], _CLASS[0xC2], _CLASS[32], _CLASS[39], _CLASS[10] = _DIGIT, _OPEN, _SPACE, _QUOTE, _LINE
_CLASS_OF = _CLASS.tobytes()
_AFTER_LINE = 2


def _cut_between(a: int, b: int) -> int:
    """1 where the pattern always begins a token between characters of two classes, 2 if a line end's place decides.

    No token has white space behind another character, none goes on behind its run of letters or digits, and none of
    signs goes on into letters but a quote's.
    """
    if a in (_SPACE, _RARE) or b == _RARE:
        return 0
    if a == _LINE:
        return 0 if b in (_SPACE, _LINE) else _AFTER_LINE
    if b in (_SPACE, _LINE):
        return 1
    if _OPEN in (a, b) or (a == _QUOTE and b == _LETTER):
        return 0
    return int((_SIGN if a == _QUOTE else a) != (_SIGN if b == _QUOTE else b))


_CUT_OF = bytes(_cut_between(k >> 3, k & 7) if k < 64 else 0 for k in range(256))


def _classes(data: bytes) -> np.ndarray:
    """Class of each byte of texts in UTF-8."""
    found = np.frombuffer(data.translate(_CLASS_OF), np.uint8)
    if data.isascii():
        return found
    found, bytes_ = found.copy(), np.frombuffer(data, np.uint8)
    first = np.flatnonzero(bytes_[:-1] == 0xC2)
    found[first] = found[first + 1] = np.where(bytes_[first + 1] > 0xA0, _OPEN, _RARE)
    first = np.flatnonzero(bytes_[:-1] == 0xC3)
    first = first[np.isin(bytes_[first + 1], (0x97, 0xB7))]
    found[first] = found[first + 1] = _OPEN
    first = np.flatnonzero(bytes_ > 0xC8)
    for later, least in ((1, 0xC9), (2, 0xE0), (3, 0xF0)):
        first = first[bytes_[first] >= least]
        found[first + later] = _RARE
    return found


def _chunk_starts(classes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that lie one behind the other and begin at ``texts``."""
    cut = np.zeros(len(classes), np.uint8)
    cut[1:] = np.frombuffer(((classes[:-1] << 3) | classes[1:]).tobytes().translate(_CUT_OF), np.uint8)
    lines = np.flatnonzero(cut == _AFTER_LINE)  # a single line end is a token, of several the last one is
    before = classes[np.maximum(lines - 2, 0)]
    cut[lines[np.isin(before, (_SPACE, _LINE, _RARE))]] = 0
    cut[texts] = 1
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Encodes texts with the tokenizers library, each distinct chunk once while it is remembered.

    Texts are cut where the tokenizer's pattern always begins a token, some megabytes at a time, and each distinct
    chunk there is looked up once. A chunk is cut by the pattern and its pieces go to the library's model; a chunk with rare
    characters, and a text with added tokens, go to the library whole. So do all texts if the tokenizer is not one whose
    settings are known to allow such cuts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        before = self.tokenizer.pre_tokenizer
        self.known = (self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and not before.add_prefix_space
                      and before.use_regex and isinstance(self.model, models.BPE) and not self.model.dropout)
        self.pieces = _Memo(self._piece)
        self.spaced = _Memo(self._word)
        self.bare = _Memo(self._chunk)

    def _ids(self, shown: str) -> bytes:
        return array.array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array.array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece[1:] in self.spaced:
            return self.spaced[piece[1:]]  # a piece is a chunk that its pattern leaves whole
        if piece.isascii() and _COMMON.fullmatch(piece):
            return self._ids(piece.replace(" ", _STANDS_FOR[32]).replace("\n", _STANDS_FOR[10]))
        return self._ids(piece.encode().decode("latin-1").translate(_STANDS_FOR))

    def _word(self, word: str) -> bytes:
        """Ids of a word and the space before it. Plain letters are one piece, which is not remembered a second time."""
        if self.known and word.isalpha():
            if word.isascii():
                return self._ids(_STANDS_FOR[32] + word)
            if _COMMON.fullmatch(word):
                return self._ids((" " + word).encode().decode("latin-1").translate(_STANDS_FOR))
        return self._chunk(" " + word)

    def _chunk(self, chunk: str) -> bytes:
        if self.known and chunk.isascii() and chunk.isalpha():
            return self._ids(chunk)
        if not self.known or not _COMMON.fullmatch(chunk):
            return self._library(chunk)
        return b"".join(map(self.pieces.__getitem__, _PATTERN.findall(chunk)))

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Numbers of the texts that go to the library whole."""
        if not self.known:
            return np.arange(len(texts))
        found = np.zeros(len(texts), bool)
        for added in self.added:
            found |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        return np.flatnonzero(found)

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text and the end id; null texts count as empty."""
        if len(self.spaced) + len(self.bare) + len(self.pieces) > MEMO_CHUNKS:
            for memo in (self.spaced, self.bare, self.pieces):
                memo.clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = self._whole(texts)
        # codes: distinct chunks, the end of a text, then whole texts with their end
        end = array.array("i", [END_ID]).tobytes()
        encoded = [self._library(t) + end for t in texts.take(pa.array(whole)).to_pylist()]
        if encoded:
            emptied = np.zeros(len(texts), bool)
            emptied[whole] = True
            texts = pc.if_else(pa.array(emptied), "", texts)
        data, offsets = _utf8(texts)
        classes = _classes(data)
        starts = _chunk_starts(classes, offsets[:-1][offsets[1:] > offsets[:-1]])
        chunks_ = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
        coded = chunks_.dictionary_encode()
        spaced, bare = self.spaced, self.bare
        found = [spaced[c[1:]] if c[0] == " " else bare[c] for c in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        ends = np.full(len(texts), len(found), np.int32)
        ends[whole] = len(found) + 1 + np.arange(len(whole))
        found += [end, *encoded]

        at = np.searchsorted(starts, offsets[1:])
        codes = np.insert(coded.indices.to_numpy(), at, ends)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        sizes_of = sizes[codes]
        upto = np.cumsum(sizes_of, dtype=np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[codes] - (upto - sizes_of)
        ids = np.frombuffer(b"".join(found), "<i4")[np.repeat(shift, sizes_of) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]
        lists = np.append(np.int32(0), upto[at + np.arange(len(at))])
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(ids, pa.int32()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit integers."""
        found = self.encode_array(pa.array(texts, pa.string()))
        flat, ends = found.values.to_numpy(), found.offsets.to_numpy()
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def _utf8(texts: pa.StringArray) -> tuple[bytes, np.ndarray]:
    """The bytes of texts that lie one behind the other, and where each begins, with the end of the last."""
    if not len(texts):
        return b"", np.zeros(1, np.int32)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""), offsets - offsets[0]


_ENCODERS: dict[str, ChunkEncoder] = {}  # of this Python worker


def _encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids) for rows of ``docs(doc_id, text)`` in their order.

    ``part`` numbers the partition and ``part_start`` counts the ids before a document in it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(tokenizer), 0
        for batch in batches:
            for lo, hi in texts_at_once(batch.column("text"), BATCH_BYTES):
                found = encoder.encode_array(batch.column("text").slice(lo, hi - lo))
                sizes = np.diff(found.offsets.to_numpy()).astype(np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(starts), pa.array(sizes), found],
                    names=["doc_id", "part_start", "n_tokens", "ids"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part_start long, n_tokens long, ids array<int>")
    return out.select("doc_id", F.spark_partition_id().alias("part"), "part_start", "n_tokens", "ids")


def write(docs: DataFrame, path: str, tokenizer: str, encoding: str = "delta", row_group_bytes: int = ROW_GROUP_BYTES,
          page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode ``docs(doc_id, text)`` and write token files, in ascending order of the id over all files.

    Null texts count as empty and have the end id only. Rows without an id come first. Rows that repeat an
    id lie together, in order of their text. ``encoding`` of the ids is "delta" or "dictionary".
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"no such encoding: {encoding}")
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (encode(ordered, tokenizer).write
     .option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document, from the files' small columns only.

    ``start`` counts the ids of all documents before it. The tokens of each part are summed, one row for a
    part, and added up in the order of the parts.
    """
    return _placed(spark.read.parquet(path).select("doc_id", "part", "part_start", "n_tokens"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents from ``first`` to ``last``; the range is pruned in the files."""
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens", "ids")


def _placed(rows: DataFrame) -> DataFrame:
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for a written part: a few bytes a file, far below the files themselves
    starts = parts.select("part", before.alias("__before"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("__before") + F.col("part_start")).drop("__before", "part", "part_start")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, the checksum taken of the ids in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "part", "part_start", "n_tokens")), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("doc_id", "part", "part_start", "n_tokens", "ids")
    summed = rows.mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    meta = spark.read.parquet(path).select("part", "n_tokens")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = meta.groupBy("part").agg(F.sum("n_tokens").alias("__n")).select("part", before.alias("__before"))
    return summed.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("__before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, encoding: str = "delta") -> DataFrame:
    """Write ``docs`` to the shared folder and return the digest of the files read back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, encoding)
    return digest(docs.sparkSession, path)
