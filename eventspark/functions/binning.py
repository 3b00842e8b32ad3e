"""Bin edges (small, made on the driver) and value -> bin expressions (run on the executors)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventspark.schema import GAUSSIAN_GRID_POINTS, small_table

TREE_THRESHOLDS = 512  # of a tree of comparisons; it makes a plan of twice as many nodes

def literal_array(values: Sequence, element: str) -> Column:
    """A constant array: one parsed string, folded by the optimizer, instead of one node per element."""
    text = ",".join(repr(v) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{element}>") if values else F.array().cast(f"array<{element}>")


@dataclass(frozen=True)
class Bins:
    """Strictly increasing edges. ``step`` is set when inner edge i is exactly ``edges[0] + i * step``."""

    name: str
    edges: tuple[float, ...]
    step: float | None = field(default=None)

    def __post_init__(self):
        if len(self.edges) < 2:
            raise ValueError(f"{self.name}: at least two edges are needed")
        if not all(math.isfinite(x) for x in self.edges):
            raise ValueError(f"{self.name}: edges must be finite")
        if any(b <= a for a, b in zip(self.edges, self.edges[1:])):
            raise ValueError(f"{self.name}: edges must be strictly increasing")

    @property
    def count(self) -> int:
        return len(self.edges) - 1

    @property
    def thresholds(self) -> tuple[float, ...]:
        return self.edges[1:-1]

    @property
    def centers(self) -> tuple[float, ...]:
        return tuple(0.5 * (a + b) for a, b in zip(self.edges, self.edges[1:]))

    def index(self, value: Column) -> Column:
        """Bin of a value: right-open, values outside the edges go to the edge bins, NaN to the last."""
        value = F.nanvl(value, F.lit(math.inf))
        if self.step is None:
            return search_sorted(value, self.thresholds).cast("int")
        return _uniform_index(value, self.edges[0], self.step, self.count - 1)

    def index_left_open(self, value: Column) -> Column:
        """Bin with left-open edges: an inner edge belongs to the bin below it."""
        mirrored = Bins(self.name, tuple(-x for x in reversed(self.edges)), None)
        return (F.lit(self.count - 1) - mirrored.index(-value)).cast("int")


def _uniform_index(value: Column, start: float, step: float, last: int) -> Column:
    # whether the value lies above or below the nearest edge is settled against that edge itself, in the
    # arithmetic that made it; a quotient alone may be off by one there
    edge = F.rint((value - F.lit(start)) / F.lit(step))
    below = (value < F.lit(start) + edge * F.lit(step)).cast("double")
    return F.least(F.greatest(edge - below, F.lit(0.0)), F.lit(float(last))).cast("int")


def search_sorted(value: Column, thresholds: Sequence[float]) -> Column:
    """Number of thresholds <= value, by bisection: a tree of comparisons, or steps over a constant array
    where the tree would make too large a plan."""
    if not thresholds:
        return F.lit(0)
    if len(thresholds) <= TREE_THRESHOLDS:
        return _bisected(value, thresholds, 0, len(thresholds))
    table = literal_array(list(thresholds), "double")
    halvings = math.ceil(math.log2(len(thresholds) + 1))

    def halve(acc, _):
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        below = F.get(table, middle) <= value
        open_ = acc["lo"] < acc["hi"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(thresholds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda acc: acc["lo"])


def _bisected(value: Column, thresholds: Sequence[float], lo: int, hi: int) -> Column:
    if lo == hi:
        return F.lit(lo)
    middle = (lo + hi) // 2
    above = value >= F.lit(float(thresholds[middle]))
    return F.when(above, _bisected(value, thresholds, middle + 1, hi)).otherwise(_bisected(value, thresholds, lo, middle))


def _check_range(start: float, stop: float) -> None:
    if not (math.isfinite(start) and math.isfinite(stop)) or stop <= start:
        raise ValueError(f"need finite start < stop, got {start}, {stop}")


def linear_bins(name: str, start: float, stop: float, n: int) -> Bins:
    """n bins of equal width."""
    _check_range(start, stop)
    if n <= 0:
        raise ValueError(f"number of bins must be positive, got {n}")
    step = (stop - start) / n
    inner = [start + i * step for i in range(n)]
    return Bins(name, (*inner, float(stop)), step)


def step_bins(name: str, start: float, stop: float, step: float) -> Bins:
    """Bins of a given width; the last one ends at ``stop`` and may be shorter."""
    _check_range(start, stop)
    if step <= 0:
        raise ValueError(f"step must be positive, got {step}")
    n = math.ceil((stop - start) / step)
    return Bins(name, (*[start + i * step for i in range(n)], float(stop)), step)


def gaussian_bins(name: str, start: float, stop: float, n: int, center: float, sigma: float = 1.0) -> Bins:
    """Bins of equal probability under a Gaussian: dense around the center, wide in the tails."""
    _check_range(start, stop)
    if n <= 0 or sigma <= 0:
        raise ValueError("number of bins and sigma must be positive")
    grid = np.linspace(start, stop, GAUSSIAN_GRID_POINTS)
    mass = np.exp(-0.5 * ((grid - center) / sigma) ** 2).cumsum()
    mass = (mass - mass[0]) / (mass[-1] - mass[0])
    inner = np.interp(np.linspace(0.0, 1.0, n + 1), mass, grid)[1:-1]
    return Bins(name, (float(start), *(float(x) for x in inner), float(stop)))


def bucketize(df: DataFrame, column: str, bins: Bins, output: str) -> DataFrame:
    """Add the bin of a column. Even bins are plain arithmetic; others go through ``Bucketizer``."""
    if bins.step is not None or bins.count < 2:
        return df.withColumn(output, bins.index(F.col(column)))
    splits = [-math.inf, *bins.thresholds, math.inf]
    model = Bucketizer(splits=splits, inputCol=column, outputCol=output, handleInvalid="keep")
    last = bins.count - 1
    return model.transform(df).withColumn(output, F.least(F.col(output).cast("int"), F.lit(last)))


def bins_table(spark, bins: Bins) -> DataFrame:
    """One row for each bin."""
    rows = [(i, lo, hi, 0.5 * (lo + hi)) for i, (lo, hi) in enumerate(zip(bins.edges, bins.edges[1:]))]
    return small_table(spark, rows, "bin int, lo double, hi double, center double")
