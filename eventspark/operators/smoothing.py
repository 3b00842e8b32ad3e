"""Smoothing of series. A series may be most of the table, so none is smoothed as one group.

Rows have a dense position in their series. Filters with a bounded reach work on chunks that borrow
neighbouring rows (a halo); the exponential average, whose reach is unbounded, is an affine recurrence
over range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventspark.operators.joins import join_summary
from eventspark.operators.ordering import affine_scan

CHUNK = 65_536


def ema(rows: DataFrame, series: str, position: str, value: str, alpha: float, output: str = "smooth") -> DataFrame:
    """y_0 = x_0, y_t = alpha x_t + (1 - alpha) y_(t-1); a NaN stays to the end of its series, a null adds nothing."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return rows.withColumn(output, F.col(value))
    first = F.col(position) == 0
    return affine_scan(rows, [position], [series], F.when(first, 0.0).otherwise(1.0 - alpha),
                       F.when(first, F.col(value)).otherwise(alpha * F.col(value)), output)


def with_halo(rows: DataFrame, position: str, halo: int, chunk: int = CHUNK) -> DataFrame:
    """Assign rows to chunks of positions and lend each chunk ``halo`` rows on both sides (``core`` is
    false for lent rows)."""
    first = F.greatest(F.floor((F.col(position) - halo) / chunk), F.lit(0)).cast("long")
    last = F.floor((F.col(position) + halo) / chunk).cast("long")
    lent = rows.withColumn("chunk", F.explode(F.sequence(first, last)))
    return lent.withColumn("core", F.floor(F.col(position) / chunk).cast("long") == F.col("chunk"))


def rolling(rows: DataFrame, series: str, position: str, value: str, window: int, method: str = "median_then_mean",
            output: str = "smooth", chunk: int = CHUNK) -> DataFrame:
    """Centered rolling mean, median, or mean of the medians; windows are shorter at the ends, and NaN is skipped."""
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    if method == "mean":
        lent = with_halo(rows, position, half, max(chunk, window))
        frame = Window.partitionBy(series, "chunk").orderBy(position).rowsBetween(-half, half)
        return lent.withColumn(output, F.avg(F.nanvl(F.col(value), F.lit(None))).over(frame)).filter("core").select(*rows.columns, output)
    if method not in ("median", "median_then_mean"):
        raise ValueError(f"unknown method {method!r}")
    twice = method == "median_then_mean"

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(position)
        y = part[value].rolling(window, center=True, min_periods=1).median()
        if twice:
            y = y.rolling(window, center=True, min_periods=1).mean()
        return part.assign(**{output: y})[part["core"]].drop(columns=["chunk", "core"])

    lent = with_halo(rows, position, 2 * window if twice else window, max(chunk, window))
    return lent.groupBy(series, "chunk").applyInPandas(smooth, _schema(rows, output))


def savgol(rows: DataFrame, series: str, position: str, value: str, window: int = 301, poly: int = 3,
           output: str = "smooth", chunk: int = CHUNK) -> DataFrame:
    """Local polynomial filter. The ends come from one polynomial over the first and last window; a
    series shorter than the window stays as it is."""
    window += 1 - window % 2
    half = window // 2
    places = np.arange(-half, half + 1)
    center_weights = np.linalg.pinv(np.vander(places, poly + 1))[-1]

    def smooth(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(position)
        y, at, n = part[value].to_numpy(float), part[position].to_numpy(), int(part["n"].iloc[0])
        out = y.copy()
        if n >= window and len(y) >= window:
            out[half:len(y) - half] = np.convolve(y, center_weights[::-1], "valid")
            if at[0] == 0:
                fit = np.polyfit(places, y[:window], poly)
                out[:half] = np.polyval(fit, places[:half])
            if at[-1] == n - 1:
                fit = np.polyfit(places, y[-window:], poly)
                out[-half:] = np.polyval(fit, places[-half:])
        return part.assign(**{output: out})[part["core"]].drop(columns=["chunk", "core", "n"])

    sizes = rows.groupBy(series).agg(F.count(F.lit(1)).alias("n"))
    lent = with_halo(join_summary(rows, sizes, [series]), position, window, max(chunk, window)).select(
        *rows.columns, "n", "chunk", "core")
    return lent.groupBy(series, "chunk").applyInPandas(smooth, _schema(rows, output))


def _schema(rows: DataFrame, output: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return ", ".join([*fields, f"`{output}` double"])


def bin_average(rows: DataFrame, series: str, position: str, columns: Sequence[str], size: int) -> DataFrame:
    """Means of consecutive groups of ``size`` rows; an incomplete last group is dropped."""
    group = F.floor(F.col(position) / size).cast("long")
    return rows.groupBy(series, group.alias("group")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(c) for c in columns]).filter(F.col("__n") == size).drop("__n")
