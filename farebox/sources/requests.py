"""Landed prediction requests (S7 input): ``request_id bigint, body string``.

A body is ``{"records": <object or list of objects>}`` with fields
``station, line, day, hour``. ``request_standin`` builds such bodies from
the driver's ``events`` table: every event is a record, in a list of at most
four or as a lone object. Awkward records are mixed in (hour as text or as a
fraction, a missing field, an unknown day or line, hour 24). Awkward bodies
come on top, under negative ids: truncated, empty list, text behind the
JSON, and a list of wrongly typed records. The stand-in only supplies rows;
parsing, validation and scoring are the job's.

``read_request_bodies`` reads bodies as they are sent, one JSON document in
each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.sources.dimensions import station_rows
from farebox.sources.literal import literal_frame

RECORDS_PER_BODY = 4
LONE_IDS = 1_000_000_000_000            # ids of lone objects start here
TYPED_RECORDS = [
    '{"station":5,"line":"1","day":"monday","hour":6}', '{"station":"Union","line":1,"day":"monday","hour":6}',
    '{"station":{"x":1},"line":"1","day":"monday","hour":6}', '{"station":"Union","line":"1","day":null,"hour":6}',
    '{"station":"Union","line":"1","day":"monday","hour":"6d"}', '{"station":"Union","line":"1","day":"monday","hour":"1e1"}',
    '{"station":"Union","line":"1","day":"monday","hour":7.0}', '{"station":"Union","line":"1","day":"monday","hour":[6]}',
    "7", "null", '{"station":"Union","line":"1","day":"monday","hour":" 8 "}',
]


def record_json_columns(eid, name, line, ts):
    """Text of one record object; field variants are chosen by event id."""
    dayname = F.date_format(ts, "EEEE")
    day = F.when(eid % 3 == 0, F.concat(F.upper(dayname), F.lit(" "))) \
           .when(eid % 23 == 0, F.lit("Holiday")).otherwise(dayname)
    station = F.when(eid % 5 == 0, F.concat(F.lit(" "), name, F.lit(" "))).otherwise(name)
    line = F.when(eid % 31 == 0, F.lit("9")).otherwise(line)
    hour_num = F.when(eid % 29 == 0, F.lit(24)).otherwise(F.hour(ts))
    hour = (F.when(eid % 13 == 0, F.concat(F.lit('"'), hour_num.cast("string"), F.lit('"')))
             .when(eid % 17 == 0, F.concat(hour_num.cast("string"), F.lit(".5")))
             .otherwise(hour_num.cast("string")))
    station_part = F.when(eid % 19 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"station":"'), station, F.lit('",')))
    return F.concat(F.lit("{"), station_part, F.lit('"line":"'), line, F.lit('","day":"'), day,
                    F.lit('","hour":'), hour, F.lit("}"))


def request_standin(spark: SparkSession, events: DataFrame) -> DataFrame:
    st = literal_frame(
        spark, [(i, name, line) for i, (name, line, _a, _b) in enumerate(station_rows())],
        "idx int, st_name string, st_line string")
    n = len(station_rows())
    e = events.select("event_id", "ts", "user_id")
    recs = (e.join(F.broadcast(st), (F.col("user_id") % n) == F.col("idx"))
            .select((F.col("event_id") / RECORDS_PER_BODY).cast("bigint").alias("request_id"),
                    "event_id",
                    record_json_columns(F.col("event_id"), F.col("st_name"), F.col("st_line"),
                                        F.col("ts")).alias("rec")))
    rid = F.col("request_id")
    grouped = recs.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "rec"))).alias("items"))
    joined = F.array_join(F.transform("items", lambda x: x["rec"]), ",")
    first = F.col("items")[0]["rec"]
    lists = grouped.where(rid % 10 != 3).select(
        rid, F.concat(F.lit('{"records": ['), joined, F.lit("]}")).alias("body"))
    lone = recs.where(rid % 10 == 3).select(
        (F.col("event_id") + LONE_IDS).alias("request_id"), F.concat(F.lit('{"records": '), F.col("rec"), F.lit("}")).alias("body"))
    extra = [(rid % 10 == 7, F.concat(F.lit('{"records": ['), first)), (rid % 50 == 11, F.lit('{"records": []}')),
             (rid % 20 == 2, F.concat(F.lit('{"records": ['), first, F.lit("]} trailing"))),
             (rid % 20 == 4, F.lit('{"records": [' + ",".join(TYPED_RECORDS) + "]}"))]
    out = lists.unionByName(lone)
    for k, (where, body) in enumerate(extra):
        out = out.unionByName(grouped.where(where).select((-(rid * len(extra) + k) - 1).alias("request_id"), body.alias("body")))
    return out


def read_request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Raw bodies, one JSON document in each file; the id is a hash of the file's path."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.input_file_name()).alias("request_id"), F.col("value").alias("body"))


def requests_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies for a driver scale-factor folder."""
    return request_standin(spark, spark.read.parquet(f"{sf_dir}/events.parquet"))
