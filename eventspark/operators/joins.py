"""Joins with a side that is small in all likelihood but not by definition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from eventspark.scratch import store


def join_summary(rows: DataFrame, summary: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a per-group summary.

    The summary is written first, so its bytes are known when the join is planned: within the session's
    broadcast limit the rows stay where they are, beyond it both sides are shuffled and hot groups split.
    """
    return rows.join(store(summary, "summary"), list(on), how)
