"""Observation cleaning: P1-P9, F1, J1.

One filter and two projections in whole-stage codegen: text is typed once, and
what reads a typed column twice (the hour, the day) comes behind. The filter
tests the hour's text, so that the planner, which moves filters to the scan, has
no cleaning steps to repeat there. Features and target stay in the same row, so
there is no index realignment (J1) and no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.hours import hour_24_to_0, is_weekend
from farebox.functions.text import is_number, norm_day, strip, to_number


def normalise(raw: DataFrame) -> DataFrame:
    """Typed, normalised columns (no rows removed).

    * day: lower + strip; station, line: strip, case kept
    * hour: numeric (text that does not parse becomes null), 24 -> 0
    * minute: constant 0; is_weekend from the normalised day
    * riders: double; service_date when a ``date`` column exists
    * obs_id: the input's whole-number id, else a hash of the row's text (rows
      with equal text then share an id and stay on one side of a split)
    """
    has_date = "date" in raw.columns
    content = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in raw.columns if c != "obs_id"])
    row_id = F.coalesce(F.col("obs_id").try_cast("bigint"), content) if "obs_id" in raw.columns else content
    typed = raw.select(
        row_id.alias("obs_id"), strip("station").alias("station"), strip("line").alias("line"), norm_day("day").alias("day"),
        to_number("hour").alias("hour"), to_number("riders").alias("riders"),
        (F.col("date").try_cast("date") if has_date else F.lit(None).cast("date")).alias("service_date"))
    return typed.select("obs_id", "station", "line", "day", hour_24_to_0("hour").alias("hour"), F.lit(0).alias("minute"),
                        is_weekend("day").alias("is_weekend"), "riders", "service_date")


def clean_observations(raw: DataFrame) -> DataFrame:
    """Rows whose hour is missing or unparsable are dropped."""
    return normalise(raw.filter(is_number("hour")))
