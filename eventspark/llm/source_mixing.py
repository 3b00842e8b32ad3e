"""Mix sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a number of words. Whole epochs come first: every document is taken as often as the
target holds its source. What is left is drawn without replacement: each document gets the exponential
key -ln(u) / w, with u from a hash of its id and w its quality weight, and the smallest keys win until the
prefix sum of their words meets the budget. The last document is taken in part, so the budget is met to
the word.

No source is sorted as a whole. Words are summed over ranges of the key, and only the range in which a
source's budget ends is put in order; a range with many rows is divided again first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventspark.scratch import store

WORD = r"[^\x20\x09-\x0D]+"
PROSE_BYTES = 6.0       # of a word of plain prose, about
SCALE_BITS, TIE_BITS, PASS_BITS = 48, 12, 12
KEY_BITS = SCALE_BITS + TIE_BITS
ORDERED_ROWS = 20_000   # rows of a source that are put in order at once
SEED = "mix"


def n_words(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column, text: str = "text") -> Column:
    """Weight in (0, 1] by how near the bytes per word are to prose; 0.05 for a text without words."""
    off = F.abs(F.octet_length(F.col(text)) / size - PROSE_BYTES) / PROSE_BYTES
    return F.when(size > 0, F.greatest(F.lit(0.05), 1.0 / (1.0 + off))).otherwise(F.lit(0.05))


def uniform(column: str = "doc_id", seed: str = SEED) -> Column:
    """A number in (0, 1) from the hash of an id; the same in every run and layout. Null counts as ''."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame) -> DataFrame:
    """Add ``__mix_size``, ``__mix_key`` and ``__mix_at``, the place of the key on a scale of 48 bits with 12 bits of
    the text's hash below: rows that repeat an id share their key, and texts part them."""
    sized = docs.withColumn("__mix_size", n_words())
    drawn = sized.withColumn("__mix_key", -F.log(uniform()) / quality_weight(F.col("__mix_size")))
    place = F.least(F.floor((1.0 - F.exp(-F.col("__mix_key"))) * float(1 << SCALE_BITS)), F.lit((1 << SCALE_BITS) - 1)).cast("long")
    tie = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    return drawn.withColumn("__mix_at", F.shiftleft(place, TIE_BITS) + tie)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): words to take from each source of ``sizes(source, source_size)``.

    Weights repeat over the sources by code point, null last. Targets share ``share`` times all words by
    weight; one stops at ``most`` times its source's words and the others share the rest by weight again,
    until none is above: target = min(most * size, level * weight) for one level. The table has one row
    for a source, so its windows are small whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), place))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # the level that spends what is left when all sources that fill up earlier are at their cap
    spent, used = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("cap", "w"))
    rows = rows.withColumn("own", (share * F.sum("source_size").over(everything) - spent) / (F.sum("w").over(everything) - used))
    first_free = F.min(F.when(F.col("own") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), "own")))
    rows = rows.withColumn("level", first_free.over(everything)["own"])
    return rows.select("source", "source_size",
                       F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _by_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join by source, null with null; ``b`` has one row for a source."""
    return a.join(b.withColumnRenamed("source", "__mix_source"), F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")


def cuts(work: DataFrame, weights: tuple[float, ...], share: float, most: float,
         ordered_rows: int = ORDERED_ROWS) -> tuple[DataFrame, int]:
    """Where each source's budget ends, and the width of a range in bits.

    (source, source_size, target, epochs, range, left): ``left`` words of the documents in ``range`` are
    taken besides the epochs, all of the ranges before it, none of those after it.
    """
    sizes = targets(work.groupBy("source").agg(F.sum("__mix_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.round("target").cast("long") - F.col("epochs") * F.col("source_size")
    known = ["source", "source_size", "target", "epochs"]
    ends = store(sizes.withColumn("epochs", epochs).withColumn("left", budget).withColumn("range", F.lit(0).cast("long")), "targets")
    shift = KEY_BITS
    while True:
        inside = _by_source(work.select("source", "__mix_size", "__mix_at"), ends).filter(F.shiftright("__mix_at", shift) == F.col("range"))
        shift -= PASS_BITS
        part = (inside.groupBy("source", F.shiftright("__mix_at", shift).alias("range"))
                .agg(F.sum("__mix_size").alias("words"), F.count(F.lit(1)).alias("n")))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
        part = part.select("source", "range", "words", "n", upto.alias("upto"))
        # the first range that holds more than what is left; none if the budget is the whole source
        found = _by_source(part, ends.drop("range", "n")).filter("upto > left").groupBy("source").agg(
            F.min(F.struct("range", (F.col("left") - F.col("upto") + F.col("words")).alias("left"), "n")).alias("end"))
        ends = store(ends.drop("range", "left").join(found.withColumnRenamed("source", "__mix_source"), F.col("source").eqNullSafe(F.col("__mix_source")), "left")
                     .select(*known, F.coalesce("end.range", F.lit(1 << PASS_BITS).cast("long") * (1 << (KEY_BITS - PASS_BITS))).alias("range"),
                             F.coalesce("end.left", F.lit(0).cast("long")).alias("left"), F.coalesce("end.n", F.lit(0).cast("long")).alias("n")), "cuts")
        if shift == 0 or (ends.agg(F.max("n")).first()[0] or 0) <= ordered_rows:
            return ends.drop("n"), shift


def with_taken(rows: DataFrame, ends: DataFrame, shift: int) -> DataFrame:
    """Add ``__mix_source_size``, ``__mix_target`` and ``__mix_taken`` to keyed rows. Only the rows of a last range are shuffled."""
    ends = ends.select("source", F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"),
                       F.col("epochs").alias("__mix_epochs"), F.col("range").alias("__mix_range"), F.col("left").alias("__mix_left"))
    rows = _by_source(rows, ends).withColumn("__mix_own", F.shiftright("__mix_at", shift))
    whole = F.col("__mix_epochs") * F.col("__mix_size")
    sure = rows.filter("__mix_own <> __mix_range").withColumn(
        "__mix_taken", whole + F.when(F.col("__mix_own") < F.col("__mix_range"), F.col("__mix_size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("__mix_at", "__mix_key", "doc_id", "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("__mix_own = __mix_range").withColumn("__mix_before", F.coalesce(F.sum("__mix_size").over(order), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("__mix_size"), F.col("__mix_left") - F.col("__mix_before")))
    last = last.withColumn("__mix_taken", whole + more).drop("__mix_before")
    return sure.unionByName(last)


def plan(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
         most: float = 2.0, ordered_rows: int = ORDERED_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs(doc_id, text, source)``.

    ``taken`` counts the words the mix takes of a document, repeats included. Null and empty texts have
    size 0 and are never taken. A null source is a source, the last. Rows that repeat an id tie in their
    key and are ordered by a hash of their text, then by size; equal rows are alike. An empty table gives an empty plan.
    """
    work = store(keyed(docs.select("doc_id", "text", "source")).drop("text"), "sizes")
    ends, shift = cuts(work, weights, share, most, ordered_rows)
    return with_taken(work, ends, shift).select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
        ordered_rows: int = ORDERED_ROWS) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a row for each epoch that takes a document.

    A document taken in part comes last with its first words only; ``n_chars``, where there is such a
    column, follows the text. Other columns pass unchanged, whatever their names. Rows without words, null and empty
    texts among them, are never taken; an empty table stays empty; for repeated ids and null sources see ``plan``.
    """
    rows = keyed(docs.select(F.struct(*docs.columns).alias("__mix_row"), "doc_id", "text", "source"))
    ends, shift = cuts(store(rows.select("source", "__mix_size", "__mix_at"), "sizes"), weights, share, most, ordered_rows)
    taken = with_taken(rows, ends, shift).filter("__mix_taken > 0")
    copies = taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__mix_taken") / F.col("__mix_size")).cast("int"))))
    words = F.least(F.col("__mix_size"), F.col("__mix_taken") - (F.col("__mix_copy") - 1) * F.col("__mix_size"))
    some = F.array_join(F.slice(F.regexp_extract_all(
        F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, words.cast("int")), "")
    row = F.col("__mix_row")
    new = {"text": F.when(words < F.col("__mix_size"), some).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(words < F.col("__mix_size"), F.length(some)).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])
