"""Options listing: G4, A2, U2, L1.

Long form first: the three text columns are stacked into (kind, value) in
one projection and de-duplicated with one shuffle, so the work grows with
the distinct values. The one-row listing gathers those distinct values, whose
number is that of the network's stations, lines and day names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.text import norm_day, strip


def options_long(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """(kind, value): hours 0..23, and the distinct non-null days (lower +
    strip), stations and lines (strip) found in the raw observations."""
    stacked = raw.select(F.explode(F.array(
        F.struct(F.lit("day").alias("kind"), norm_day("day").alias("value")),
        F.struct(F.lit("station").alias("kind"), strip("station").alias("value")),
        F.struct(F.lit("line").alias("kind"), strip("line").alias("value")),
    )).alias("kv")).select("kv.kind", "kv.value")
    found = stacked.where(F.col("value").isNotNull()).distinct()
    hours = spark.range(24).select(F.lit("hour").alias("kind"),
                                   F.col("id").cast("string").alias("value"))
    return found.unionByName(hours)


def options_listing(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """G4 shape: one row ``hours array<int>, days, stations, lines array<string>``,
    each sorted ascending (codepoint order)."""
    long = options_long(spark, raw).filter(F.col("kind") != "hour")
    per_kind = long.groupBy("kind").agg(F.array_sort(F.collect_list("value")).alias("vals"))
    lists = per_kind.agg(*[
        F.coalesce(F.max(F.when(F.col("kind") == k, F.col("vals"))),
                   F.array().cast("array<string>")).alias(alias)
        for k, alias in (("day", "days"), ("station", "stations"), ("line", "lines"))])
    return lists.select(F.sequence(F.lit(0), F.lit(23)).alias("hours"), "days", "stations", "lines")
