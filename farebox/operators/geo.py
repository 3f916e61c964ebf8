"""Map dimension queries: S5, F7, J5, P14, P15, P16, P19, P20.

The station and path tables are fixed literals (about a hundred rows), so
they are always broadcast. Display coordinates are literals of the station
table too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.display import js_riders_text, py_riders_text, to_fixed
from farebox.sources.dimensions import line_colours, line_path, station_rows
from farebox.sources.literal import literal_frame


def station_markers(spark: SparkSession) -> DataFrame:
    """F7 + P16 + P19: markers with 4-decimal display coordinates and colour."""
    rows = [(name, line, lat, lon, to_fixed(lat, 4), to_fixed(lon, 4)) for name, line, lat, lon in station_rows()]
    markers = literal_frame(spark, rows, "name string, line string, lat double, lon double, lat_text string, lon_text string")
    return markers.join(F.broadcast(line_colours(spark)), "line", "left").select(
        "name", "line", "lat", "lon", "lat_text", "lon_text", "css_colour")


def station_predictions(spark: SparkSession, profile: DataFrame, combos: DataFrame) -> DataFrame:
    """Every map station with its predictions, matched on (name, line).

    ``profile`` is (station, line, day, hour, riders, ...) of ``combos``
    (station, line, ...). It is joined to the broadcast marker table (56 rows),
    so profile rows stream and are never shuffled on the station key: a station
    holding a large share of the rows cannot skew a partition. Stations without
    any prediction are found from ``combos``, not from a second evaluation of
    the profile, and keep one row with nulls, as a left join would give.
    """
    markers = station_markers(spark)
    keys = ["name", "line"]
    prof = profile.withColumnRenamed("station", "name").select(
        "name", "line", "day", "hour", "riders")
    matched = prof.join(F.broadcast(markers), keys, "inner")
    present = (combos.select(F.col("station").alias("name"), "line")
               .join(F.broadcast(markers.select(*keys)), keys, "left_semi").distinct())
    unmatched = (markers.join(F.broadcast(present), keys, "left_anti")
                 .select("*", F.lit(None).cast("string").alias("day"),
                         F.lit(None).cast("int").alias("hour"),
                         F.lit(None).cast("double").alias("riders")))
    joined = matched.unionByName(unmatched)
    return joined.select(
        "name", "line", "lat_text", "lon_text", "css_colour", "day", "hour", "riders",
        js_riders_text("riders").alias("riders_text"),
        py_riders_text("riders").alias("riders_py_text"))


def line_paths(spark: SparkSession) -> DataFrame:
    """P20 + P19: each line's ordered [lat, lon] list and colours."""
    path = line_path(spark)
    per_line = path.groupBy("line").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))),
                    lambda p: F.array(p["lat"], p["lon"])).alias("path"),
        F.count_if("show_marker").alias("n_stations"))
    return per_line.join(F.broadcast(line_colours(spark)), "line", "left")


def line_summary(spark: SparkSession, obs: DataFrame) -> DataFrame:
    """Per line found in the observations: row count and mean riders,
    with the map path, station count and colour where the line is mapped."""
    agg = (obs.where(F.col("line").isNotNull()).groupBy("line")
           .agg(F.count(F.lit(1)).alias("n_obs"),
                (F.sum("riders").cast("double") / F.count("riders")).alias("mean_riders")))
    paths = line_paths(spark)
    colours = line_colours(spark).select("line", F.col("css_colour").alias("colour"))
    joined = (agg.join(F.broadcast(paths.select("line", "path", "n_stations")), "line", "left")
              .join(F.broadcast(colours), "line", "left"))
    # A line without a map path has an empty path and no stations on the map.
    return (joined.withColumn("n_stations", F.coalesce("n_stations", F.lit(0).cast("bigint")))
            .withColumn("path", F.coalesce("path", F.array().cast("array<array<double>>"))))
