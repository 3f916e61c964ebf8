"""Profiles: G1, G2, G3, J2, J4, P23.

The reference builds one small grid per (station, line, day) and scores it
in a loop; here the grid for every combination is one ``explode`` of an
hour array (no cross join), scored by a single model pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.hours import all_hours, hours_for_daytype, is_weekend, service_open
from farebox.functions.display import title_day
from farebox.functions.text import strip
from farebox.operators.scan import order_statistics
from farebox.session import materialize

COMBO = ["station", "line", "day"]


def combinations(df: DataFrame) -> DataFrame:
    """Distinct (station, line, day) present in ``df``."""
    return df.select(*COMBO).distinct()


def profile_24h(model, combos: DataFrame) -> DataFrame:
    """Hours 0..23 for every combination; closed hours (serve policy) are
    exactly 0 riders, open hours take the model's prediction."""
    grid = (combos.select(*COMBO, F.explode(all_hours()).alias("hour"))
            .withColumn("minute", F.lit(0)).withColumn("is_weekend", is_weekend("day")))
    is_open = service_open("day", "hour", None, "serve")
    scored = model.predict(grid)
    return scored.select(
        *COMBO, "hour", is_open.alias("is_open"),
        F.when(is_open, F.col("prediction")).otherwise(F.lit(0.0)).alias("riders"))


def open_hours_profile(model, combos: DataFrame) -> DataFrame:
    """G1 + P18: the day's plotting hours (start..23, 0, 1) kept by the train
    mask, with the model's prediction (no zeroing: closed hours are not in
    it) and the chart title "<station> — Estimated riders by hour (<Day>)"."""
    grid = (combos.select(*COMBO, F.explode(hours_for_daytype("day")).alias("hour"))
            .withColumn("minute", F.lit(0)).withColumn("is_weekend", is_weekend("day"))
            .filter(service_open("day", "hour", "minute", "train")))
    title = F.concat(F.col("station"), F.lit(" — Estimated riders by hour ("),
                     title_day("day"), F.lit(")"))
    return model.predict(grid).select(*COMBO, "hour", F.col("prediction").alias("riders"),
                                      title.alias("title"))


def typical_line(df: DataFrame) -> DataFrame:
    """G3 + J4: most common line per station (matched case-insensitively),
    ties -> smallest; a station with no known line gets the most common
    line overall. One partial aggregate over the rows builds a stored
    (station, line) count table, bounded by the station and line domains;
    the per-station choice and the network-wide fallback both read it."""
    keyed = df.select(F.lower(strip("station")).alias("station_key"), "line")
    # Rows without a station stay in the table: they count for the fallback.
    counted = materialize(df.sparkSession, keyed.groupBy("station_key", "line").agg(F.count(F.lit(1)).alias("_n")),
                          "line-counts")
    order = F.struct(F.col("line").isNull().alias("missing"),
                     (-F.col("_n")).alias("neg_n"), F.col("line").alias("v"))
    per_station = (counted.where(F.col("station_key").isNotNull()).groupBy("station_key")
                   .agg(F.min_by("line", order).alias("line")))
    overall = (counted.where(F.col("line").isNotNull()).groupBy("line")
               .agg(F.sum("_n").alias("_n"))
               .agg(F.min_by("line", F.struct((-F.col("_n")).alias("neg_n"),
                                               F.col("line").alias("v"))).alias("line"))
               .first())
    fallback = overall["line"] if overall is not None else None
    return per_station.select(
        "station_key",
        F.coalesce(F.col("line"), F.lit(fallback)).alias("line"),
        F.col("line").isNull().alias("is_fallback"))


def congestion_levels(profile: DataFrame, low_q: float = 1 / 3, high_q: float = 2 / 3) -> DataFrame:
    """P23 (our semantics): network-wide thresholds at the given quantiles of
    open-hour riders, then low / medium / high. Thresholds are exact (the
    smallest value that the share of rows reaches), found by rounds of bounded
    counts. The profile is read in each, so pass a stored one."""
    found = order_statistics(profile.filter("is_open"), "riders", [low_q, high_q])
    if found is None:
        return profile.withColumn("level", F.lit(None).cast("string"))
    low, high = found
    level = (F.when(~F.col("is_open"), F.lit("closed"))
             .when(F.col("riders") <= low, F.lit("low"))
             .when(F.col("riders") <= high, F.lit("medium"))
             .otherwise(F.lit("high")))
    return profile.withColumn("level", level)


def typical_line_for(df: DataFrame, station_name: str):
    """G3 for one station name (matched case-insensitively): its most common
    line, or the network's most common line when it has none."""
    key = station_name.strip().lower()
    row = typical_line(df).filter(F.col("station_key") == key).select("line").first()
    if row is not None:
        return row["line"]
    overall = (df.where(F.col("line").isNotNull()).groupBy("line")
               .agg(F.count(F.lit(1)).alias("_n"))
               .agg(F.min_by("line", F.struct((-F.col("_n")).alias("neg_n"),
                                               F.col("line").alias("v"))).alias("line"))
               .first())
    return overall["line"] if overall is not None else None


def profile_for(spark, model, station: str, line: str, day: str, hours: str = "open") -> DataFrame:
    """One combination's profile: ``hours="open"`` gives G1 (plotting hours
    kept by the train mask), ``hours="all"`` gives G2 (0..23, closed = 0)."""
    combo = spark.createDataFrame([(station, line, day)], "station string, line string, day string")
    return open_hours_profile(model, combo) if hours == "open" else profile_24h(model, combo)
