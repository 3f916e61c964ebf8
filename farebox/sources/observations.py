"""Ridership observation sources.

Raw observations arrive as a CSV with header ``Station, Line, Day, Hour,
Riders`` (any case, optionally ``Date``). Every column is read as text, names
are lower-cased and missing-value tokens are nulled; typing happens in
``operators.clean`` with ``try_cast``, which reproduces a tolerant parse and
keeps an all-digit line such as ``"1"`` as text.

``observation_standin`` builds rows of the same shape from the driver's
``events`` table, so that every query runs on data that grows with it. It
only supplies rows (with deliberately dirty text); it does none of the
cleaning, filtering or modelling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.text import null_tokens
from farebox.sources.csv_records import read_csv_records
from farebox.sources.dimensions import station_rows
from farebox.sources.literal import literal_frame

def lower_names(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def with_null_tokens(df: DataFrame) -> DataFrame:
    """Turn missing-value tokens into nulls in every text column."""
    cols = []
    for field in df.schema.fields:
        if field.dataType.simpleString() == "string":
            cols.append(null_tokens(F.col(field.name)).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def read_observations_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV read, lower-case names, missing tokens nulled.

    No schema inference (a full extra pass at scale, and it would turn an
    all-digit line column into numbers); no trimming (normalising is a
    separate, explicit step). Doubled quotes inside a quoted field stand for
    one; a quoted field may hold commas and line breaks. Files without any quote
    go straight to Spark's reader, which splits them at line ends; with quotes,
    records are cut by ``sources.csv_records``, also in parallel.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    if lines.where(F.contains("value", F.lit('"'))).isEmpty():
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').csv(path))
    else:
        df = read_csv_records(spark, path)
    return with_null_tokens(lower_names(df))


def read_observations_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Same contract for a parquet landing of the raw text columns."""
    return read_observations_parquet_df(spark.read.parquet(path))


def observation_standin(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Raw observation rows in the CSV's shape, made from ``events``.

    One row per event: the station (and its line) is picked from the map's
    56 station markers by ``user_id``, the day and hour come from ``ts`` and
    riders from ``value``. Text is made dirty on purpose (padding, upper
    case, tabs, tokens, an unknown day, hour 24, missing values) so that
    the cleaning steps have work to do.
    """
    st = literal_frame(
        spark, [(i, name, line) for i, (name, line, _lat, _lon) in enumerate(station_rows())],
        "idx int, st_name string, st_line string")
    n = len(station_rows())
    eid, uid = F.col("event_id"), F.col("user_id")
    dayname = F.date_format("ts", "EEEE")
    hour = F.hour("ts")
    e = events.select("event_id", "ts", "user_id", "value")
    # The station list has a fixed size: a broadcast is always safe.
    j = e.join(F.broadcast(st), (uid % n) == F.col("idx"))
    return j.select(
        eid.alias("obs_id"),
        F.when(eid % 4 == 0, F.concat(F.lit("  "), "st_name", F.lit(" ")))
         .when(eid % 89 == 0, F.upper("st_name"))
         .otherwise(F.col("st_name")).alias("Station"),
        F.when(eid % 83 == 0, F.lit("NA"))
         .when(eid % 7 == 0, F.concat(F.lit(" "), "st_line"))
         .when(eid % 11 == 0, F.concat("st_line", F.lit("\t")))
         .when(uid % 10 == 0, F.lit("4"))
         .otherwise(F.col("st_line")).alias("Line"),
        F.when(eid % 97 == 0, F.lit(None).cast("string"))
         .when(eid % 101 == 0, F.lit("Holiday"))
         .when(eid % 5 == 0, F.concat(F.lit(" "), F.upper(dayname), F.lit(" ")))
         .when(eid % 5 == 1, F.lower(dayname))
         .otherwise(dayname).alias("Day"),
        F.when(eid % 79 == 0, F.lit(None).cast("string"))
         .when(eid % 131 == 0, F.lit("n/a"))
         .when((hour == 0) & (eid % 2 == 0), F.lit("24"))
         .otherwise(hour.cast("string")).alias("Hour"),
        F.when(eid % 103 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("Riders"),
        F.col("ts").cast("date").cast("string").alias("Date"),
    )


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (text) observations for a driver scale-factor folder, with the S1 contract."""
    return read_observations_parquet_df(observation_standin(spark, spark.read.parquet(f"{sf_dir}/events.parquet")))


def read_observations_parquet_df(df: DataFrame) -> DataFrame:
    return with_null_tokens(lower_names(df))
