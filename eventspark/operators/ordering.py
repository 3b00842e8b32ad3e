"""Positions, running sums and next values over a total order, without one big task.

Rows are range-partitioned by (group, order) into a written table, so a group that holds a third of the
rows is spread over many tasks. Running values are taken inside each partition, and what the earlier
partitions add comes from a carry table with at most two rows for each partition. Where the caller knows
that a group fits a task, as the particles of one event do, a plain window needs less.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventspark.schema import small_table
from eventspark.scratch import store

PARTITIONS: int | None = None  # of a range partitioning; None leaves the number to the session
_ROW, _PART = "__row", "__part"
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row number below


def running(
    df: DataFrame,
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    following: Mapping[str, str] | None = None,
    bounded: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``position`` (from 0), inclusive running ``sums`` and ``following`` (next row's column).

    ``order_by`` has to be a total order inside a group, otherwise tied rows may swap places. Null keys form
    a group of their own. ``bounded`` promises that no group outgrows a task.
    """
    order_by, group_by = list(order_by), list(group_by)
    sums, following = dict(sums or {}), dict(following or {})
    if bounded:
        if not group_by:
            raise ValueError("the whole table is no bounded group")
        window = Window.partitionBy(*group_by).orderBy(*order_by)
        return df.withColumns(_over(window, position, sums, following))
    ranged = ranges(df, order_by, group_by, sums, partitions)
    return carried(ranged, group_by, position, sums, following, df.columns)


def ranges(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str], sums: Mapping[str, Column],
           partitions: int | None = None) -> DataFrame:
    """The rows in written range partitions, numbered in their order."""
    keys = [*group_by, *order_by]
    work = df.withColumns({f"__add_{name}": col for name, col in sums.items()})
    partitions = partitions or PARTITIONS
    dealt = work.repartitionByRange(partitions, *keys) if partitions else work.repartitionByRange(*keys)
    stored = store(dealt.sortWithinPartitions(*keys).withColumn(_ROW, F.monotonically_increasing_id()), "ranged")
    return stored.withColumn(_PART, F.shiftright(_ROW, _ROW_BITS))


def _over(window, position, sums, following) -> dict[str, Column]:
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = {}
    if position:
        new[position] = F.row_number().over(window).cast("long") - 1
    new |= {name: F.sum(col).over(upto) for name, col in sums.items()}
    new |= {name: F.lead(col).over(window) for name, col in following.items()}
    return new


def carried(ranged: DataFrame, group_by: Sequence[str], position: str | None, sums: Mapping[str, Column], following: Mapping[str, str],
            columns: Sequence[str]) -> DataFrame:
    """``running`` over the written partitions of ``ranges``, with the given columns of the rows."""
    totals = ranged.groupBy(*group_by, _PART).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(f"__add_{name}").alias(f"__sum_{name}") for name in sums],
        *[F.min_by(col, _ROW).alias(f"__first_{name}") for name, col in following.items()])
    by_part = Window.partitionBy(*group_by).orderBy(_PART)
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    keys = {g: f"__group{k}" for k, g in enumerate(group_by)}
    carry = totals.select(
        *[F.col(g).alias(k) for g, k in keys.items()], F.col(_PART).alias("__at"),
        F.sum("__n").over(before).alias("__before"),
        *[F.sum(f"__sum_{name}").over(before).alias(f"__before_{name}") for name in sums],
        F.lead(_PART).over(by_part).alias("__later"),
        *[F.lead(f"__first_{name}").over(by_part).alias(f"__next_{name}") for name in following],
    ).filter("__before is not null or __later is not null")

    window = Window.partitionBy(_PART, *group_by).orderBy(_ROW)
    local = _over(window, position, {n: F.col(f"__add_{n}") for n in sums}, following)
    local["__last"] = F.lead(_ROW).over(window).isNull()
    same = F.col(_PART) == F.col("__at")
    for g, k in keys.items():
        same = same & F.col(g).eqNullSafe(F.col(k))
    # at most two groups of a range partition continue in another one: the carry table has no more
    # than two rows for each partition, whatever the data
    joined = ranged.withColumns(local).join(F.broadcast(carry), same, "left")
    final = {}
    if position:
        final[position] = F.col(position) + F.coalesce("__before", F.lit(0))
    for n in sums:
        earlier = F.col(f"__before_{n}")
        final[n] = F.when(earlier.isNull(), F.col(n)).when(F.col(n).isNull(), earlier).otherwise(F.col(n) + earlier)
    # the last row of a group in its partition is followed by the first of the next partition
    final |= {n: F.when(F.col("__last"), F.col(f"__next_{n}")).otherwise(F.col(n)) for n in following}
    kept = [c for c in columns if c not in final] + list(final)
    return joined.withColumns(final).select(*kept)


def with_position(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (), name: str = "position",
                  bounded: bool = False, partitions: int | None = None) -> DataFrame:
    """Dense row number from 0 in the given order."""
    return running(df, order_by, group_by, position=name, bounded=bounded, partitions=partitions)


# --- affine recurrences ---------------------------------------------------------------

def affine_scan(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str], factor: Column, addend: Column, output: str,
                partitions: int | None = None) -> DataFrame:
    """Add ``output``: y_t = factor_t * y_(t-1) + addend_t in the given order, from 0 before a group's first row.

    Maps y -> a y + b are closed under composition, so each range partition composes its own rows, from
    zero, and writes for every row what the partition adds and by what it multiplies the value before it.
    That value is the carry: one row for each partition, folded in their order. A group may fill any number of
    partitions. NaN stays to the end of its group; a null factor or addend counts as 1 or 0.
    """
    order_by, group_by = list(order_by), list(group_by)
    keys = [*group_by, *order_by]
    work = df.withColumns({"__a": F.coalesce(factor.cast("double"), F.lit(1.0)), "__b": F.coalesce(addend.cast("double"), F.lit(0.0)),
                           "__key": F.xxhash64(*group_by) if group_by else F.lit(0).cast("long")})
    partitions = partitions or PARTITIONS
    dealt = work.repartitionByRange(partitions, *keys) if partitions else work.repartitionByRange(*keys)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the map from what stood before the partition (its first group) or zero (later groups) to the row."""
        part, place, key, value, power, first = TaskContext.get().partitionId(), 0, None, 0.0, 1.0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, a, b = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("__key", "__a", "__b"))
            starts = np.r_[key is not None and keys[0] != key, keys[1:] != keys[:-1]]
            cut = starts.copy()
            if key is not None and not starts[0]:
                b[0], a[0] = (a[0] * value if value or a[0] else 0.0) + b[0], a[0] * power
            cut[0] = True
            step = 1
            while step < n and not cut.all():  # doubling: after k rounds a row holds the maps of 2^k rows
                open_ = ~cut[step:]
                b[step:] = np.where(open_, a[step:] * b[:-step] + b[step:], b[step:])
                a[step:] = np.where(open_, a[step:] * a[:-step], a[step:])
                cut[step:] |= cut[:-step]
                step *= 2
            is_first = np.logical_not(np.logical_or.accumulate(starts)) & first
            columns = [batch.column(c) for c in batch.schema.names if c not in ("__key", "__a", "__b")]
            names = [c for c in batch.schema.names if c not in ("__key", "__a", "__b")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(keys), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(is_first),
                 pa.array(a), pa.array(b)], names=[*names, "__key", "__part", "__place", "__first", "__a", "__b"])
            place, key, value, power, first = place + n, keys[-1], b[-1], a[-1], bool(is_first[-1])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = dealt.sortWithinPartitions(*keys).mapInArrow(
        composed, f"{fields}, __key long, __part int, __place long, __first boolean, __a double, __b double")
    stored = store(local, "scanned")
    ends = stored.groupBy("__part").agg(F.max_by(F.struct("__key", "__first", "__a", "__b"), "__place").alias("end"),
                                        F.min_by("__key", "__place").alias("key")).orderBy("__part")
    carries, before, before_key = [], 0.0, None
    for row in ends.toLocalIterator():  # one for each partition
        goes_on = before_key is not None and row["key"] == before_key
        if goes_on:
            carries.append((row["__part"], before))
        end = row["end"]
        before = end["__a"] * before + end["__b"] if end["__first"] and goes_on else end["__b"]
        before_key = end["__key"]
    carry = small_table(df.sparkSession, carries, "__at int, __carry double")
    joined = stored.join(F.broadcast(carry), F.col("__first") & (F.col("__part") == F.col("__at")), "left")
    whole = F.when(F.col("__carry").isNull(), F.col("__b")).otherwise(F.col("__a") * F.col("__carry") + F.col("__b"))
    return joined.select(*df.columns, whole.alias(output))
