"""Landed context payloads: ``fetched_at timestamp, status int, body string``.

The reference fetches current weather and the day's venue events as JSON
over HTTP and reads them immediately; here responses are landed as rows and
read as tables (the HTTP calls themselves are not part of the engine).

The stand-ins below build such rows from the driver's ``events`` table: one
weather response and one listed event for every row, events grouped into
pages. Failed responses and empty bodies come on top, so no row of ``events``
is lost to them; some events have missing parts. The stand-ins only supply
rows; parsing and everything after is the job's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.sources.dimensions import VENUE_COORDS, VENUES
from farebox.sources.literal import literal_frame

# Invented condition texts for the weather stand-in (not reference data).
CONDITIONS = ["Sunny", "Partly cloudy", "Light rain", "Overcast"]
EVENT_PAGE_IDS = 250   # event ids per landed page
OTHER_VENUE = ("KovZpZAOther", "Other Venue")


def weather_standin(events: DataFrame) -> DataFrame:
    e = events
    eid = F.col("event_id")
    cond = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]),
                        (F.col("user_id") % len(CONDITIONS) + 1).cast("int"))
    temp = (F.col("value").cast("decimal(18,2)") - 15).cast("string")
    ok_body = F.concat(F.lit('{"location":{"name":"Metro"},"current":{"temp_c":'), temp,
                       F.lit(',"condition":{"text":"'), cond, F.lit('"}}}'))
    good = e.select(F.col("ts").alias("fetched_at"), F.lit(200).alias("status"), ok_body.alias("body"))
    failed = e.where(eid % 13 == 0).select(
        F.col("ts").alias("fetched_at"), F.lit(500).alias("status"),
        F.lit('{"error":{"code":1006,"message":"No matching location found."}}').alias("body"))
    return good.unionByName(failed)


def _venue_json(spark: SparkSession) -> DataFrame:
    coords = {name: (lat, lon) for name, lat, lon in VENUE_COORDS}
    rows = []
    for i, (vid, name, _cap) in enumerate(VENUES + [OTHER_VENUE + (0,)]):
        loc = ""
        if name in coords:
            lat, lon = coords[name]
            loc = f',"location":{{"latitude":"{lat}","longitude":"{lon}"}}'
        rows.append((i, f'{{"id":"{vid}","name":"{name}"{loc}}}'))
    return literal_frame(spark, rows, "v_idx int, venue_json string")


def events_payload_standin(spark: SparkSession, events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id")
    eid = F.col("event_id")
    n_venues = len(VENUES) + 1
    v = _venue_json(spark)  # nine rows: a broadcast is always safe
    j = e.join(F.broadcast(v), (F.col("user_id") % n_venues) == F.col("v_idx"))
    dates = F.concat(F.lit('"dates":{"start":{"localDate":"'), F.col("ts").cast("date").cast("string"),
                     F.lit('","localTime":"'), F.date_format("ts", "HH:mm:ss"), F.lit('"}},'))
    venues = (F.when(eid % 19 == 0, F.lit('"_embedded":{"venues":[]},'))
               .otherwise(F.concat(F.lit('"_embedded":{"venues":['), F.col("venue_json"),
                                   F.lit("]},"))))
    ev = F.concat(
        F.lit('{"id":"E'), eid.cast("string"), F.lit('",'),
        F.when(eid % 17 == 0, F.lit("")).otherwise(dates),
        F.when(eid % 23 == 0, F.lit("")).otherwise(venues),
        F.lit('"name":"Event '), eid.cast("string"), F.lit('"}'))
    pages = (j.select(F.col("ts").cast("date").alias("d"),
                      (eid / EVENT_PAGE_IDS).cast("bigint").alias("page"), "ts", "event_id",
                      ev.alias("ev"))
             .groupBy("d", "page")
             .agg(F.min("ts").alias("fetched_at"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "ev"))),
                                           lambda x: x["ev"]), ",").alias("evs")))
    page = F.col("page")
    body = F.concat(F.lit('{"_embedded":{"events":['), F.col("evs"),
                    F.lit(']},"page":{"number":'), page.cast("string"), F.lit("}}"))
    good = pages.select("fetched_at", F.lit(200).alias("status"), body.alias("body"))
    empty = pages.where(page % 7 == 3).select("fetched_at", F.lit(200).alias("status"), F.lit("{}").alias("body"))
    failed = pages.where(page % 11 == 5).select(
        "fetched_at", F.lit(500).alias("status"), F.lit('{"errors":[{"code":"SERVER_ERROR"}]}').alias("body"))
    return good.unionByName(empty).unionByName(failed)


def landed_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather_standin(spark.read.parquet(f"{sf_dir}/events.parquet"))


def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_payload_standin(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))


def clock_text_standin(events: DataFrame) -> DataFrame:
    """Free-text clock times in three shapes ("3:34 PM", "15:34", "6–7 a.m.")
    from ``events.ts``; rows only, parsing is the job's."""
    ts, eid = F.col("ts"), F.col("event_id")
    h = F.hour(ts)
    h12 = (h + 11) % 12 + 1
    ap = F.when(h < 12, F.lit("a.m.")).otherwise(F.lit("p.m."))
    text = (F.when(eid % 3 == 0, F.date_format(ts, "h:mm a"))
             .when(eid % 3 == 1, F.date_format(ts, "HH:mm"))
             .otherwise(F.concat(h12.cast("string"), F.lit("–"), (h12 % 12 + 1).cast("string"),
                                 F.lit(" "), ap)))
    return events.select("event_id", "ts", text.alias("clock_text"))
