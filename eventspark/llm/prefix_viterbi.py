"""SentencePiece encoding by a Viterbi search that words with a common beginning share, and decoding.

Spaces become the mark U+2581 and one mark goes in front of the text. No piece holds a mark behind another
character, so no piece crosses the place where a new marked word begins, and a text is a sequence of marked
words. The distinct words of a batch of texts are sorted; sorted words are the leaves of a trie in
depth-first order, and the forward state of a prefix stays on a stack for all words that begin with it.
The next word starts behind its common prefix with the one before, and adds one state for each further
character.

The forward state of a prefix is the best path of pieces that ends there. What a path costs depends on the
model. In a unigram model it is the sum of the pieces' scores. In a merge (BPE) model scores are an order
of merges, not weights of pieces: there a step from one piece to the next costs nothing if merging the two
pieces' characters gives back just these two pieces, and is forbidden otherwise. The result of merging a
prefix is the one path of allowed steps, so every prefix has one state here as well, and the ids are those
of the library.

Characters without a piece, and marks that the text itself holds, are written as bytes, so decoding gives
back every text exactly.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from eventspark.llm.common import map_texts

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS = 100_000  # about 25 MB
MEMO_STEPS = 20_000   # pieces whose followers are remembered
_WORD = re.compile(r" *[^ ]+| +")


@dataclass
class Pieces:
    """Pieces of a model: ids and scores by text, the ids of bytes, the text of each id, and whether scores
    order merges (BPE) or are added (unigram)."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    texts: list[bytes]
    merges: bool = True

    def __post_init__(self):
        # pieces by their characters from last to first: a search looks back from each place
        self.tree: dict = {}
        for piece, score in self.scores.items():
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} holds a mark behind another character")
            node = self.tree
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece if self.merges else score
        self.byte_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str, merges: bool = True) -> Pieces:
        """Read a model file with the sentencepiece library. Control pieces have no text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, texts, bytes_ = {}, {}, [], [-1] * 256
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                bytes_[int(piece[3:5], 16)] = k
                texts.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                texts.append(b"")
            else:
                ids[piece], scores[piece] = k, model.get_score(k)
                texts.append(piece.replace(MARK, " ").encode())
        if min(bytes_) < 0:
            raise ValueError("the model has no byte pieces, which whole texts need")
        return cls(ids, scores, bytes_, texts, merges)


def marked_words(text: str | None) -> list[str | None]:
    """Marked words of a text, in order; None stands for a mark that the text itself holds.

    A word is a run of marks and the characters up to the next mark.
    """
    if not text:
        return []
    out: list[str | None] = []
    for k, part in enumerate(text.split(MARK)):
        if k:
            out.append(None)
        elif not part:
            part = " "  # the mark in front of every text, alone
            out.append(MARK)
            continue
        part = part if k else " " + part
        if "  " in part or part[-1:] == " ":
            out.extend(w.replace(" ", MARK) for w in _WORD.findall(part))
        elif part:
            first, *rest = part.split(" ")
            if first:
                out.append(first)
            out.extend([MARK + w for w in rest])
    return out


def merge(word: str, scores: dict[str, float]) -> list[str]:
    """Pieces of a short string by merging: the pair with the best score first, of equal ones the leftmost."""
    parts = list(word)
    while True:
        found = [(-scores[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in scores]
        if not found:
            return parts
        k = min(found)[1]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


class Following(dict):
    """Whether a piece may follow ``before``, found by merging both when it is first asked; "" begins a word."""

    def __init__(self, before: str, scores: dict[str, float]):
        self.before, self.scores = before, scores

    def __missing__(self, piece: str) -> bool:
        want = [self.before, piece] if self.before else [piece]
        allowed = self[piece] = merge(self.before + piece, self.scores) == want
        return allowed


class SharedViterbi:
    """Best segmentations of words given in sorted order."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.word, self.best, self.back = "", [0.0], [0]  # forward scores and piece starts on the stack
        self.after: dict[str, Following] = {}
        self.next = [Following("", pieces.scores)]        # and, for a merge model, what may follow
        self.reused = self.computed = 0

    def ids(self, word: str) -> list[int]:
        last, common = self.word, 0
        most = min(len(word), len(last))
        while common < most and word[common] == last[common]:
            common += 1
        del self.best[common + 1:], self.back[common + 1:], self.next[common + 1:]
        self.reused += common
        self.computed += len(word) - common
        (self._by_steps if self.pieces.merges else self._by_scores)(word, common)
        self.word = word
        return self._collect(word)

    def _by_scores(self, word: str, common: int) -> None:
        best, back, tree, byte_score = self.best, self.back, self.pieces.tree, self.pieces.byte_score
        for end in range(common + 1, len(word) + 1):
            start = end - 1
            top, node, k = best[start] + byte_score, tree, end
            while k:
                k -= 1
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    s = node[""] + best[k]
                    if s >= top:  # of equal sums the longer piece
                        top, start = s, k
            best.append(top)
            back.append(start)

    def _by_steps(self, word: str, common: int) -> None:
        back, nexts, tree, after = self.back, self.next, self.pieces.tree, self.after
        if len(after) > MEMO_STEPS:
            after.clear()
        for end in range(common + 1, len(word) + 1):
            start = k = end - 1
            piece = c = word[k]
            if not nexts[k][c]:
                node = tree.get(c)
                while k and node is not None:
                    k -= 1
                    node = node.get(word[k])
                    if node is None:
                        break
                    longer = node.get("")
                    if longer is not None and nexts[k][longer]:
                        start, piece = k, longer
                        break
            back.append(start)
            following = after.get(piece)
            if following is None:
                following = after[piece] = Following(piece, self.pieces.scores)
            nexts.append(following)

    def _collect(self, word: str) -> list[int]:
        out, end, known = [], len(word), self.pieces
        while end:
            start = self.back[end]
            piece = known.ids.get(word[start:end])
            if piece is None:
                out.extend(known.bytes_[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass")))
            else:
                out.append(piece)
            end = start
        out.reverse()
        return out


def encode_words(words: set[str], pieces: Pieces, search: SharedViterbi | None = None) -> dict[str, bytes]:
    """Ids of distinct words as little-endian 32-bit integers, searched in sorted order."""
    search = search or SharedViterbi(pieces)
    return {word: array("i", search.ids(word)).tobytes() for word in sorted(words)}


class Encoder:
    """Encodes texts in batches and remembers words between them, up to a bound."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.own = pieces, array("i", [pieces.bytes_[b] for b in MARK.encode()]).tobytes()
        self.memo: dict = {None: self.own}
        self.search = SharedViterbi(pieces)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = [marked_words(t) for t in texts]
        new = set().union(*words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo = {None: self.own}
            new = set().union(*words).difference(self.memo)
        self.memo.update(encode_words(new, self.pieces, self.search))
        get = self.memo.__getitem__
        return [b"".join(map(get, ws)) for ws in words]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of ids. Bytes that are no valid UTF-8 become U+FFFD; control ids have no text."""
    return b"".join(map(pieces.texts.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _lists(found: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker: later tasks know the words of earlier ones


def _encoder(model_path: str) -> Encoder:
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = Encoder(Pieces.load(model_path))
    return _ENCODERS[model_path]


def encode(docs: DataFrame, model_path: str, keep: list[str] | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``ids``, an array of int.

    A projection: no shuffle, memory for some megabytes of text and a bounded number of words. Null and empty texts give
    no ids. A column that is already called ``ids`` is replaced. Every executor needs the model file under
    ``model_path``.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != ids]
    carried = [c for c in keep if c != text]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(ids, ArrayType(IntegerType()))])

    def worker():
        encoder = _encoder(model_path)
        return lambda rows, texts: pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), _lists(encoder.encode(texts))], names=[*keep, ids])

    return map_texts(docs.select(*carried, text), schema, worker, text)


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the column ``text`` decoded from ``ids``; null ids give null."""
    keep = [c for c in tokens.columns if c != text]
    schema = StructType([tokens.schema[c] for c in keep] + [StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(model_path).pieces
        for batch in batches:
            texts = [None if x is None else decode_ids(x, pieces) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text])

    return tokens.select(*keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids, same): every text encoded, decoded again and compared.

    ``same`` says that decoding gave the text back (a null text counts as empty). Encoding and decoding
    run over one batch after the other in the same task, so no text is moved or written.
    """
    def worker():
        encoder = _encoder(model_path)

        def work(rows, texts):
            found = encoder.encode(texts)
            same = [decode_ids(np.frombuffer(x, "<i4").tolist(), encoder.pieces) == (t or "") for x, t in zip(found, texts)]
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(x) // 4 for x in found], pa.int64()),
                 pa.array([zlib.crc32(x) for x in found], pa.int64()), _lists(found), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_crc32", "ids", "same"])

        return work

    return map_texts(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_crc32 long, ids array<int>, same boolean", worker)
