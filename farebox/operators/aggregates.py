"""Aggregates the reference relies on: A1, A6 (A2 lives in ``options``).

``most_frequent`` is computed as two grouped aggregates instead of one
``mode`` map per group: the first counts (key, value) pairs with map-side
partial aggregation, so a key that holds a third of all rows is reduced on
every mapper before the shuffle; the second picks, per key, the value with
the highest count (ties: smallest value) with ``min_by``, again partial.
Memory per task is bounded by the number of distinct pairs in a partition,
not by group size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(df: DataFrame, value: str, keys: list[str] | None = None,
                  alias: str | None = None) -> DataFrame:
    """Mode of ``value`` per ``keys``; nulls ignored; ties -> smallest.

    Groups whose values are all null produce no row.
    """
    keys = keys or []
    out = alias or value
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    rank = F.struct((-F.col("_n")).alias("neg_n"), F.col(value).alias("v"))
    return counted.groupBy(*keys).agg(F.min_by(F.col(value), rank).alias(out))
