"""Keep an expensive expression from being evaluated more than once.

The optimizer moves filters below projections by copying the expressions they mention. For an array
expression over a whole event that multiplies the work. Values that come out of a generator are not
copied, so a one-element explode pins the result as a plain attribute; no shuffle, no extra row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` whose result is computed once for each row."""
    others = [c for c in df.columns if c != name]
    out = df.select(*others, F.explode(F.array(value)).alias(name))
    order = [*df.columns] if name in df.columns else [*df.columns, name]
    return out.select(*order)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
