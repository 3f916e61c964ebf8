"""Scans over a global order in two levels: no task sees more than its range.

``forward_fill`` (J6): rows are dealt to ranges of the order and stored with the
number of their range. The last value of each range goes to the driver (one row
for each range), where what is carried into each range is read off; a window
inside each range does the rest.

``order_statistics`` (P23): the values at given ranks, exactly, from a histogram
refined over rounds. A round counts rows in at most ``BUCKETS`` buckets of equal
width and keeps their smallest and largest value; the bucket that holds the rank
is the next round's range. It ends where all values of a bucket are equal, or few
enough rows are left to look at their distinct values.
"""

from __future__ import annotations

from math import ceil, inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.session import materialize

BUCKETS = 4096
BOUNDARY_ROWS = 65_536


def forward_fill(rows: DataFrame, order: list[str], column: str) -> DataFrame:
    """``rows`` with nulls of ``column`` replaced by the value of the nearest
    earlier row that has one; null before the first. Null keys come first."""
    spark = rows.sparkSession
    laid = materialize(spark, rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    known = laid.where(F.col(column).isNotNull())
    lasts = known.groupBy("_part").agg(F.max_by(column, F.struct(*order)).alias("_last"))
    carried, last = [], None
    found = {r["_part"]: r["_last"] for r in lasts.collect()}             # one row for each range
    for part in range(max(found, default=-1) + 2):
        carried.append((part, last))
        last = found.get(part, last)
    kind = laid.schema[column].dataType.simpleString()
    # A range behind all values is carried the very last one.
    before = spark.createDataFrame(carried, f"_part int, _before {kind}")
    rank = F.least("_part", F.lit(len(carried) - 1))
    so_far = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = laid.withColumn(column, F.last(column, ignorenulls=True).over(so_far)).withColumn("_rank", rank)
    joined = filled.join(F.broadcast(before.withColumnRenamed("_part", "_rank")), "_rank")
    return joined.withColumn(column, F.coalesce(column, "_before")).select(*rows.columns)


def ranks_of(shares: list[float], n: int) -> list[int]:
    """Rank, from 1, of the smallest value that each share of ``n`` rows reaches."""
    return [min(max(ceil(q * n), 1), n) for q in shares]


def order_statistics(rows: DataFrame, column: str, shares: list[float]) -> list[float] | None:
    """For each share, the smallest value of a double column that so many rows are
    at or below; None without values. Infinities count; NaN and null don't."""
    values = rows.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    finite = (F.col("x") > -inf) & (F.col("x") < inf)
    size = values.agg(F.count("*").alias("n"), F.count_if(F.col("x") == -inf).alias("below"), F.count_if(finite).alias("finite"),
                      F.min(F.when(finite, F.col("x"))).alias("low"), F.max(F.when(finite, F.col("x"))).alias("high")).first()
    if not size["n"]:
        return None
    out = []
    for rank in ranks_of(shares, size["n"]):
        rank -= size["below"]
        out.append(-inf if rank <= 0 else inf if rank > size["finite"]
                   else _value_at(values.where(finite), rank, size["low"], size["high"], size["finite"]))
    return out


def _value_at(values: DataFrame, rank: int, low: float, high: float, n: int) -> float:
    """The ``rank``-th smallest of ``n`` values between ``low`` and ``high``."""
    while True:
        if low == high:
            return low
        inside = values.where(F.col("x").between(low, high))
        if n <= BOUNDARY_ROWS:
            counts = sorted(tuple(r) for r in inside.groupBy("x").count().collect())
            ends, keys = [(v, v) for v, _ in counts], [c for _, c in counts]
        else:
            # Halves keep the width finite; whole buckets, the last one closed.
            share = (F.col("x") / 2 - low / 2) / (high / 2 - low / 2)
            bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
            found = sorted(tuple(r) for r in inside.groupBy(bucket.alias("b")).agg(F.min("x"), F.max("x"), F.count("*")).collect())
            ends, keys = [r[1:3] for r in found], [r[3] for r in found]
        for (low, high), n in zip(ends, keys):
            if rank <= n:
                break
            rank -= n
