"""Group spelling variants of the words of all texts by Bloom-guided neighbourhoods.

The words' near words are those one inserted, deleted or replaced letter away. Each word's edits are
generated as hashes, which follow from the word's own hash without building the edited word, and probed
against Bloom filters of the vocabulary: one for each word length, blocked (all bits of a word lie in 512),
and split by hash where a length has many words. Only positives are shuffled, to a join with the vocabulary
that removes the false ones; the words of what is left are compared letter by letter.

Filters are broadcast in passes of at most ``PASS_BYTES``, however large the vocabulary: a pass holds the
filters of some lengths or parts of them, and only words that can have neighbours there probe it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventspark.llm.common import mixed
from eventspark.scratch import store

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
DAMAGED = 31                    # one run in so many loses a letter
PART_WORDS = 1 << 16            # of a part of a length's filter
PASS_BYTES = 32 << 20           # of the filters that are broadcast at once
BITS_A_WORD, PROBES = 16, 6
BLOCK_WORDS = 8                 # 64-bit words of a block: 512 bits
_EDITS_AT_ONCE = 1 << 20
_WORDS_A_TASK = 20_000          # a word costs about a thousand probes
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def vocabulary(docs: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): words of at least 7 letters that occur at least twice in all texts.

    A word is a maximal run of letters with A-Z in lower case. With h the crc32 of ``<doc_id>:<run>``, a run
    whose h is divisible by ``damaged`` loses its letter number h modulo its length. A null id counts as an
    empty one, null texts have no words. Occurrences are summed in every task before words are shuffled.
    """
    runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LETTERS},}}"), F.lit(0))  # shorter runs cannot get longer
    upper = "".join(map(chr, range(65, 91)))
    low = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select(
        "id", F.translate("run", upper, upper.lower()).alias("run"))
    h = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"), F.char_length("run").cast("long").alias("length"))
    at = (F.col("h") % F.col("length")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("length").cast("int")))
    words = h.select(F.when(F.col("h") % damaged == 0, less).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= LEAST_COUNT))


# --- hashes of words and their edits ------------------------------------------------

def _letter_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters) of the words of each length: their places in the list and a matrix of code points."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, _EDITS_AT_ONCE // max(1, int(length)))
        for lo in range(0, len(rows), step):
            some = rows[lo:lo + step]
            text = "".join(words[k] for k in some)
            yield some, np.frombuffer(text.encode("latin-1"), np.uint8).reshape(len(some), length)


def hashes(letters: np.ndarray) -> np.ndarray:
    """Sum of letter value times a power of the base for its place, modulo 2^64."""
    return (_letter_values()[letters] * _powers(letters.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _deletions(letters: np.ndarray) -> np.ndarray:
    """Hashes of the words without the letter at each place."""
    upto = np.cumsum(_letter_values()[letters] * _powers(letters.shape[1])[:-1], axis=1, dtype=np.uint64)
    before = np.c_[np.zeros((len(letters), 1), np.uint64), upto[:, :-1]]
    return before + (upto[:, -1:] - upto) * np.uint64(_BASE_INVERSE)


def _replacements(letters: np.ndarray, own: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes) of the words with each other letter of ``alphabet`` at each place, some at a time."""
    values, powers = _letter_values(), _powers(letters.shape[1])
    step = max(1, _EDITS_AT_ONCE // max(1, len(letters) * len(alphabet)))
    for lo in range(0, letters.shape[1], step):
        here = letters[:, lo:lo + step]
        change = (values[alphabet] - values[here][:, :, None]) * powers[lo:lo + here.shape[1]][:, None]
        other = alphabet != here[:, :, None]
        yield np.nonzero(other)[0], (own[:, None, None] + change)[other]


# --- filters ------------------------------------------------------------------------

def _places(z: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of the block and the number that the bits in it come from."""
    z = mixed(z)
    return ((z >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64) * BLOCK_WORDS, mixed(z + np.uint64(1))


def _bit(source: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    nine = (source >> np.uint64(9 * k)) & np.uint64(511)
    return (nine >> np.uint64(6)).astype(np.int64), np.uint64(1) << (nine & np.uint64(63))


def blocks_for(words: int) -> int:
    return max(1, -(-words * BITS_A_WORD // (64 * BLOCK_WORDS)))


def build(keys: np.ndarray, blocks: int) -> np.ndarray:
    bits = np.zeros(blocks * BLOCK_WORDS, np.uint64)
    block, source = _places(keys, blocks)
    for k in range(PROBES):
        word, mask = _bit(source, k)
        np.bitwise_or.at(bits, block + word, mask)
    return bits


def may_hold(bits: np.ndarray, blocks: int, keys: np.ndarray, slot: np.ndarray | int = 0) -> np.ndarray:
    """Places of the keys that a filter may hold; after each bit only those that had it go on.

    ``bits`` has filters of ``blocks`` blocks one after the other; ``slot`` says which one a key belongs to.
    """
    at = np.arange(len(keys))
    block, source = _places(keys, blocks)
    block = block + slot * (blocks * BLOCK_WORDS)
    for k in range(PROBES):
        word, mask = _bit(source, k)
        there = (bits[block + word] & mask) != 0
        at, block, source = at[there], block[there], source[there]
    return at


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(33)) % np.uint64(parts)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) with the word's length, hash and set of letters (a to z, and from U+00C0 on)."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        key, length = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
        low, high = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint64)
        for rows, letters in by_length(words):
            key[rows], length[rows] = hashes(letters), letters.shape[1]
            code = letters.astype(np.int64)
            low[rows] = np.bitwise_or.reduce(np.where(code < 128, 1 << (code - 97).clip(0, 25), 0), axis=1)
            high[rows] = np.bitwise_or.reduce(np.where(code >= 192, np.uint64(1) << (code - 192).clip(0).astype(np.uint64), np.uint64(0)), axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), pa.array(length), pa.array(key.view(np.int64)), pa.array(low),
             pa.array(high.view(np.int64))], names=["word", "n", "length", "key", "low", "high"])


def _filters(words: DataFrame, part_words: int, pass_bytes: int) -> DataFrame:
    """(length, part, parts, blocks, low, high, bits, pass): the filters with the letters of their length's words."""
    sizes = words.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
    parts = F.ceil(F.col("n") / part_words)
    # a row for each length, written so that its size is known before it is joined: no word moves by its length
    sizes = store(sizes.select("length", "low", "high", parts.cast("int").alias("parts"), F.greatest(
        F.lit(1), F.ceil(F.col("n") / parts * BITS_A_WORD / (64 * BLOCK_WORDS))).cast("int").alias("blocks")), "lengths")
    dealt = (words.select("length", "key").join(sizes, "length")
             .withColumn("part", F.pmod(F.shiftrightunsigned("key", 33), F.col("parts")).cast("int")))

    def one(rows: pa.Table) -> pa.Table:
        bits = build(rows["key"].to_numpy().view(np.uint64), rows["blocks"][0].as_py())
        return rows.slice(0, 1).drop_columns(["key"]).append_column("bits", pa.array([bits.tobytes()], pa.binary()))

    made = store(dealt.select("length", "part", "parts", "blocks", "low", "high", "key").groupBy("length", "part").applyInArrow(
        one, "length int, part int, parts int, blocks int, low long, high long, bits binary"), "filters")
    # a row for each part of a length: the order is over numbers, not over filters
    upto = F.sum("bytes").over(Window.orderBy("length", "part").rowsBetween(Window.unboundedPreceding, -1))
    passes = made.select("length", "part", F.octet_length("bits").cast("long").alias("bytes")).select(
        "length", "part", F.floor(F.coalesce(upto, F.lit(0)) / pass_bytes).cast("int").alias("pass"))
    return made.join(passes, ["length", "part"])


def _probing(shared):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {}
        for length, (parts, blocks, alphabet, held) in shared.value.items():
            slots = np.full(parts, -1)
            slots[sorted(held)] = np.arange(len(held))
            filters[length] = (slots, blocks, np.frombuffer(b"".join(held[p] for p in sorted(held)), np.uint64), np.array(alphabet, np.uint8))

        def positives(length, rows, keys):
            slots, blocks, bits, _ = filters[length]
            slot = slots[_part_of(keys, len(slots)).astype(np.int64)]
            here = np.flatnonzero(slot >= 0)  # the other parts have their own pass
            at = here[may_hold(bits, blocks, keys[here], slot[here])]
            if len(at):
                yield rows[at], keys[at], length

        def found(batch):
            words = batch.column("word").to_pylist()
            for rows, letters in by_length(words):
                length = letters.shape[1]
                if length in filters:
                    for of, keys in _replacements(letters, hashes(letters), filters[length][3]):
                        yield from positives(length, rows[of], keys)
                if length - 1 in filters:
                    yield from positives(length - 1, np.repeat(rows, length), _deletions(letters).ravel())

        for batch in batches:
            for rows, keys, length in found(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(rows)), batch.column("length").take(pa.array(rows)),
                     pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), length, np.int32))],
                    names=["key", "length", "to_key", "to_length"])

    return probe


def _alphabet(low: int, high: int) -> list[int]:
    return [97 + k for k in range(26) if low >> k & 1] + [192 + k for k in range(64) if high >> k & 1]


def near_words(vocab: DataFrame, part_words: int = PART_WORDS, pass_bytes: int = PASS_BYTES) -> tuple[DataFrame, DataFrame]:
    """The keyed vocabulary and (word, n, near, near_n), a row for each word and each of its near words."""
    spark = vocab.sparkSession
    words = store(vocab.mapInArrow(_keyed, "word string, n long, length int, key long, low long, high long"), "words")
    filters = store(_filters(words, part_words, pass_bytes), "filters")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-words.count() // _WORDS_A_TASK))
    positives = None
    for number in range((filters.agg(F.max("pass")).first()[0] or 0) + 1):
        held: dict[int, tuple] = {}
        for r in filters.filter(F.col("pass") == number).toLocalIterator():
            held.setdefault(r["length"], (r["parts"], r["blocks"], _alphabet(r["low"], r["high"]), {}))[3][r["part"]] = bytes(r["bits"])
        lengths = sorted({n for length in held for n in (length, length + 1)})
        probing = words.filter(F.col("length").isin(lengths)).select("word", "length", "key")
        some = probing.repartition(tasks, "key").mapInArrow(
            _probing(spark.sparkContext.broadcast(held)), "key long, length int, to_key long, to_length int")
        positives = some if positives is None else positives.unionByName(some)
    to = words.select(F.col("key").alias("to_key"), F.col("length").alias("to_length"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = (positives.join(to, ["to_key", "to_length"]).join(words.select("key", "length", "word", "n"), ["key", "length"])
             .filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct())
    pairs = store(pairs, "near")
    # replacements find each other; a deletion is found from the longer word only
    shorter = pairs.filter(F.char_length("near") < F.char_length("word")).select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return words, pairs.unionByName(shorter)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows: forms followed to the last one, twice as far in each round.

    A form occurs ten times as often as its word, so no chain is longer than the digits of a count, and a
    word is the form of no more words than it has edits: no key is hot.
    """
    state = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = state.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        if state.join(far, "root", "left_semi").isEmpty():
            return state
        state = store(state.join(far, "root", "left").select("word", F.coalesce("farther", "root").alias("root")), "roots")


def variants(docs: DataFrame, times: int = TIMES, part_words: int = PART_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocabulary(docs)``.

    A word's form is its commonest near word (ties: the smallest), if that occurs at least ``times`` as often,
    else null; the root follows forms to the last, and is the word itself where there is no form. An empty
    table, or one without repeated words, gives no rows. Repeated rows count as often as they are there;
    very long runs are words like others.
    """
    words, pairs = near_words(vocabulary(docs), part_words, pass_bytes)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    named = store(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(named.filter("form is not null"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
