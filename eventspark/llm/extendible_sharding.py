"""Shards under a byte limit by extendible hashing.

Every row has a string of hash bits. A directory entry is a prefix of it; the shard of an entry holds the
rows whose bits begin with that prefix. The directory starts as one entry, the empty prefix, and only an
entry whose rows exceed the byte limit is split on another bit. The bits are the MD5 of the id, so a shard
depends on the id alone; rows that share an id go on with bits of a hash of the row, so a repeated id can be
split as well. One row that is larger than the limit stays a shard of its own.

Bytes are summed by prefixes of several bits at a time, which combine before they are shuffled, and the
sums of shorter prefixes follow from those. Only rows of entries that are still too large are summed
again. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.scratch import store

LIMIT = 1 << 20
ID_BITS, ROW_BITS = 128, 64
PASS_BITS = 12


def _binary(digits: Column, bits: int) -> Column:
    """Hexadecimal digits as a string of bits, sixteen digits at a time."""
    parts = [F.lpad(F.conv(F.substring(digits, k // 4 + 1, 16), 16, 2), 64, "0") for k in range(0, bits, 64)]
    return F.concat(*parts)


def hash_bits(row: Column, id_: str = "doc_id") -> Column:
    """The bits of a row: MD5 of its id (null as the empty text), then 64 bits of ``row``, a hash."""
    return F.concat(_binary(F.md5(F.coalesce(F.col(id_).cast("string"), F.lit(""))), ID_BITS),
                    _binary(F.lpad(F.hex(row), 16, "0"), ROW_BITS))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__bits`` and ``__bytes``. The place of a row in the plan tells equal rows apart, so the result
    has to be stored before it is used twice."""
    row = F.xxhash64(F.col(text), F.monotonically_increasing_id())
    return docs.withColumns({"__bits": hash_bits(row),
                             "__bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")})


def directory(rows: DataFrame, limit: int = LIMIT, pass_bits: int = PASS_BITS) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_rows) for every shard of ``rows(__bits, __bytes)``.

    No prefix begins another, and every row's bits begin with one of them. Empty for an empty table.
    """
    last = ID_BITS + ROW_BITS
    open_, base, found = rows.select("__bits", "__bytes"), 0, None
    while True:
        deep = min(base + pass_bits, last)
        sums = store(open_.groupBy(F.substring("__bits", 1, deep).alias("prefix"))
                     .agg(F.sum("__bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows")), "prefixes")
        # every prefix between the known depth and this one, with its sums
        levels = (sums.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(deep))))
                  .groupBy("depth", F.expr("substring(prefix, 1, depth)").alias("prefix"))
                  .agg(F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_rows").alias("shard_rows")))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == last)
        levels = levels.withColumn("fits", fits)
        # an entry is a shard if it fits and the entry above it had to be split
        above = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("__above"), (~F.col("fits")).alias("__split"))
        judged = levels.withColumn("__above", F.expr("substring(prefix, 1, greatest(depth - 1, 0))")).join(above, ["depth", "__above"], "left")
        judged = store(judged.withColumn("__split", F.coalesce("__split", F.col("depth") == base)), "levels")
        shards = judged.filter("fits and __split").select("prefix", "depth", "shard_bytes", "shard_rows")
        found = shards if found is None else found.unionByName(shards)
        large = judged.filter((F.col("depth") == deep) & ~F.col("fits")).select(F.col("prefix").alias("__prefix"))
        if deep == last or large.isEmpty():
            return found
        open_ = open_.join(large, F.substring("__bits", 1, deep) == F.col("__prefix"), "left_semi")
        base = deep


def assign(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Add the columns of ``shards`` to ``rows``, each row with the prefix that its bits begin with.

    Rows meet the directory by the first bits that all its entries have, and pick their own among the few
    entries below those; hash bits spread rows evenly over them. An oversized id makes one longer list.
    """
    least = shards.agg(F.min("depth")).first()[0] or 0
    entries = shards.groupBy(F.substring("prefix", 1, least).alias("__begin") if least else F.lit("").alias("__begin")).agg(
        F.collect_list(F.struct("prefix", "depth", "shard_bytes", "shard_rows")).alias("__entries"))
    begin = F.substring("__bits", 1, least) if least else F.lit("")
    own = F.filter("__entries", lambda e: F.startswith(F.col("__bits"), e["prefix"]))[0]
    return (rows.withColumn("__begin", begin).join(entries, "__begin").withColumn("__own", own)
            .select(*rows.columns, F.col("__own.prefix").alias("shard"), F.col("__own.depth").alias("depth"),
                    F.col("__own.shard_bytes").alias("shard_bytes"), F.col("__own.shard_rows").alias("shard_rows")))


def shard_table(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_rows) for every row of ``docs(doc_id, text)``.

    ``shard`` is the prefix as a text of 0 and 1, empty for a single shard. Null texts have 0 bytes, rows
    without an id hash as the empty id. Rows that repeat an id may be divided between shards. An empty
    table gives an empty result.
    """
    rows = store(keyed(docs.select("doc_id", "text")).drop("text"), "bits")
    shards = store(directory(rows, limit), "directory")
    return assign(rows, shards).select("doc_id", F.col("__bytes").alias("bytes"), "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Write ``docs`` below ``path``, a folder ``shard=s<prefix>`` for each shard; returns the directory.

    The folder's column gets a trailing ``_`` for as long as ``docs`` has a column of that name.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = store(keyed(docs).select(F.struct(*docs.columns).alias("__row"), "__bits", "__bytes"), "keyed")
    shards = store(directory(rows, limit), "directory")
    placed = assign(rows, shards).select("__row.*", F.concat(F.lit("s"), "shard").alias(name))
    placed.repartition(name).write.partitionBy(name).parquet(path)
    return shards
