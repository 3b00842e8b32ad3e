"""Exact quantiles of a column of any size, and bins of equal frequency made from them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.functions.binning import Bins, literal_array
from eventspark.operators.ordering import running
from eventspark.scratch import store


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles.

    ``percentile`` would hold all distinct values in one buffer. Here equal values are counted first, a
    running sum over the ordered values gives every value its ranks, and only the values at the wanted
    ranks reach the driver.
    """
    counted = store(df.filter(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(column).agg(
        F.count(F.lit(1)).alias("n")), "counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    if not total:
        raise ValueError(f"no values in {column}")
    places = [share * (total - 1) for share in shares]
    ranks = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    upto = running(counted, [column], sums={"upto": F.col("n")})
    hit = F.filter(literal_array(ranks, "bigint"), lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n")))
    at = {r["rank"]: r["value"] for r in upto.select(F.col(column).alias("value"), F.explode(hit).alias("rank")).collect()}
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def quantile_bins(df: DataFrame, column: str, n: int, accuracy: int | None = None) -> Bins:
    """Equal-frequency bins learned from the whole column: exact, or with ``accuracy`` from a sketch."""
    shares = [i / n for i in range(n + 1)]
    if accuracy is None:
        edges = exact_quantiles(df, column, shares)
    else:
        edges = df.agg(F.percentile_approx(column, shares, accuracy).alias("edges")).first()["edges"]
    return Bins(column, tuple(sorted(set(edges))))
