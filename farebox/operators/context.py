"""Weather and event context: S3, S4, F6, F8, J6, J7, L2, P10, P11, P12, P18.

Landed responses are parsed with ``from_json`` against a fixed schema in
which every level is optional, so a missing key is a null, never an error.
Fusion with the observations goes through small per-day lookup tables (24
rows per date for weather, one per date for events), which the planner
broadcasts by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from farebox.functions.display import event_line
from farebox.functions.hours import all_hours
from farebox.operators.scan import forward_fill

WEATHER_SCHEMA = "struct<current: struct<temp_c: double, condition: struct<text: string>>>"
EVENT_TYPE = ("struct<id: string, name: string, "
              "dates: struct<start: struct<localDate: string, localTime: string>>, "
              "_embedded: struct<venues: array<struct<id: string, name: string, "
              "location: struct<latitude: string, longitude: string>>>>>")
EVENTS_SCHEMA = f"struct<_embedded: struct<events: array<{EVENT_TYPE}>>>"
PAGE_SIZE = 100


def successful(landed: DataFrame) -> DataFrame:
    """F8: responses usable as payloads (HTTP 200)."""
    return landed.filter(F.col("status") == 200)


def failed(landed: DataFrame) -> DataFrame:
    """F8: every other response, kept for reporting."""
    return landed.filter(F.col("status").isNull() | (F.col("status") != 200)).select(
        "fetched_at", "status", F.col("body").alias("error_text"))


def weather_readings(landed: DataFrame) -> DataFrame:
    """S3: fetched_at, temp_c, condition from successful weather responses."""
    j = F.from_json("body", WEATHER_SCHEMA)
    return successful(landed).select(
        "fetched_at",
        j["current"]["temp_c"].alias("temp_c"),
        j["current"]["condition"]["text"].alias("condition"))


def event_listings(landed: DataFrame) -> DataFrame:
    """S4 + P10 + P18: one row per event in successful responses, with the
    first venue (null when the list is missing or empty), coordinates as
    numbers, and the printed message line."""
    j = F.from_json("body", EVENTS_SCHEMA)
    ev = successful(landed).select(F.explode(j["_embedded"]["events"]).alias("e"))
    start = F.col("e.dates.start")
    venue = F.get(F.col("e._embedded.venues"), 0)
    flat = ev.select(
        F.col("e.id").alias("event_id"),
        F.col("e.name").alias("name"),
        start["localDate"].alias("local_date"),
        start["localTime"].alias("local_time"),
        venue["id"].alias("venue_id"),
        venue["name"].alias("venue_name"),
        venue["location"]["latitude"].alias("lat_text"),
        venue["location"]["longitude"].alias("lon_text"))
    return flat.select(
        "event_id", "name", F.col("local_date").try_cast("date").alias("event_date"),
        "local_date", "local_time", "venue_id", "venue_name",
        F.col("lat_text").try_cast("double").alias("lat"),
        F.col("lon_text").try_cast("double").alias("lon"),
        event_line("local_date", "local_time", "name", "venue_name", "lat_text", "lon_text")
        .alias("message"))


def day_window(date_col) -> tuple:
    """``{day}T00:00:00Z`` and ``{day}T23:59:59Z`` for a date column."""
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return (F.date_format(d, "yyyy-MM-dd'T'00:00:00'Z'"),
            F.date_format(d, "yyyy-MM-dd'T'23:59:59'Z'"))


def chosen_venue_events(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """F6 (venue part): events at one of the chosen venues (left-semi join
    with the fixed venue dimension, broadcast: its size is fixed)."""
    return listings.join(F.broadcast(venues.select("venue_id")), "venue_id", "left_semi")


def daily_listing(listings: DataFrame, venues: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """F6 + L2 + P12: per day, the first ``page_size`` events at chosen venues
    that start inside the day window, ordered by start time then id.

    Ranking is a window partitioned by date with a rank filter, which Spark
    plans with a partial per-partition top-k before the shuffle, so a busy
    day sends at most ``page_size`` rows per task to its partition.
    """
    lo, hi = day_window("event_date")
    starts = F.concat("local_date", F.lit("T"), "local_time", F.lit("Z"))
    inside = chosen_venue_events(listings, venues).filter(
        F.col("event_date").isNotNull() & F.col("local_time").isNotNull()
        & starts.between(lo, hi))
    w = Window.partitionBy("event_date").orderBy("local_time", "event_id")
    return (inside.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= page_size))


def events_for_day(listings: DataFrame, venues: DataFrame, day: str,
                   page_size: int = PAGE_SIZE) -> DataFrame:
    """F6 for one date parameter (``yyyy-MM-dd``): that day's first
    ``page_size`` chosen-venue events. The date is always passed in, never
    taken from the clock."""
    one_day = listings.filter(F.col("event_date") == F.lit(day).cast("date"))
    return daily_listing(one_day, venues, page_size)


def event_windows(days: DataFrame, listings: DataFrame, venues: DataFrame, venue_ids: list[str]) -> DataFrame:
    """P11 + P12: per requested day (``days(event_date)``), with or without
    events, the request window, the chosen venue ids joined in list order, and
    the number of their events listed for the day."""
    lo, hi = day_window("event_date")
    found = (chosen_venue_events(listings, venues).filter(F.col("event_date").isNotNull())
             .groupBy("event_date").agg(F.count(F.lit(1)).alias("n_events")))
    return days.select("event_date").distinct().join(found, "event_date", "left").select(
        "event_date", lo.alias("start_bound"), hi.alias("end_bound"), F.lit(",".join(venue_ids)).alias("venue_query"),
        F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"))


def hourly_weather(readings: DataFrame, dates: DataFrame) -> DataFrame:
    """J6, per (date, hour) of ``dates(service_date)``: the latest reading at or
    before the start of the hour, be it from an earlier day (null before the
    first reading of all).

    A reading counts from the next full hour on (its own if it is on the hour).
    The latest per hour is a grouped aggregate; it is carried forward over the
    hours of all dates by a scan in two levels (``operators.scan``).
    """
    start = F.date_trunc("hour", "fetched_at")
    counts_from = F.when(F.col("fetched_at") == start, start).otherwise(start + F.expr("INTERVAL 1 HOUR"))
    latest = (readings.select(counts_from.alias("at"), F.struct("fetched_at", "temp_c", "condition").alias("rd"))
              .groupBy(F.col("at").cast("date").alias("service_date"), F.hour("at").alias("hour")).agg(F.max("rd").alias("rd")))
    every = dates.select("service_date").where("service_date is not null").unionByName(latest.select("service_date")).distinct()
    grid = every.select("service_date", F.explode(all_hours()).alias("hour"))
    filled = forward_fill(grid.join(latest, ["service_date", "hour"], "left"), ["service_date", "hour"], "rd")
    return filled.select("service_date", "hour",
                         F.col("rd.fetched_at").alias("weather_at"),
                         F.col("rd.temp_c").alias("temp_c"),
                         F.col("rd.condition").alias("condition"))


def daily_events(listings: DataFrame, venues: DataFrame) -> DataFrame:
    """J7 (per day): number of chosen-venue events and their total capacity."""
    cap = F.broadcast(venues.select("venue_id", "capacity"))
    return (listings.filter(F.col("event_date").isNotNull()).join(cap, "venue_id")
            .groupBy(F.col("event_date").alias("service_date"))
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum("capacity").cast("bigint").alias("event_capacity")))


def fuse_context(obs: DataFrame, readings: DataFrame, listings: DataFrame,
                 venues: DataFrame) -> DataFrame:
    """J6 + J7: each observation with the weather in force at its hour and
    the day's event count and capacity (0 when there were none)."""
    weather = hourly_weather(readings, obs)
    events = daily_events(listings, venues)
    with_weather = obs.join(weather, ["service_date", "hour"], "left")
    fused = with_weather.join(events, ["service_date"], "left")
    return fused.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("bigint"))) \
                .withColumn("event_capacity", F.coalesce("event_capacity", F.lit(0).cast("bigint")))
