"""Hour lists (U1, U2), service hours per day (G5), CSV text handling."""

from pyspark.sql import functions as F

from farebox.functions.hours import all_hours, hours_for_daytype
from farebox.operators.service_hours import service_hours_by_day
from farebox.session import scratch_path
from farebox.sources.observations import read_observations_csv


def test_hours_for_daytype(spark):
    df = spark.createDataFrame([("monday",), ("Sunday",), ("holiday",)], "day string")
    got = {r[0]: r[1] for r in df.select("day", hours_for_daytype("day")).collect()}
    assert got["monday"] == list(range(6, 24)) + [0, 1] and len(got["monday"]) == 20
    assert got["Sunday"] == list(range(8, 24)) + [0, 1] and len(got["Sunday"]) == 18
    assert got["holiday"][0] == 8
    assert df.select(all_hours()).first()[0] == list(range(24))


def test_service_hours_by_day(spark):
    obs = spark.createDataFrame([("monday",), ("saturday",), ("holiday",), (None,)], "day string")
    rows = service_hours_by_day(obs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["day"], []).append((r["hour"], r["open_train"], r["open_serve"]))
    assert sorted(h for h, _, _ in by["monday"]) == [0, 1] + list(range(6, 24))
    assert sorted(h for h, _, _ in by["saturday"]) == [0, 1] + list(range(8, 24))
    # unknown day: train policy opens at 8, serve policy at 6
    holiday = {h: (t, s) for h, t, s in by["holiday"]}
    assert holiday[6] == (False, True) and holiday[8] == (True, True)
    assert None not in by


def test_csv_reader_keeps_text_and_nulls_tokens(spark):
    path = scratch_path(spark, "csv-tokens")
    lines = ["Station,Line,Day,Hour,Riders", "  Union ,1,Monday,6,10.5", "Bay,NA,,24,N/A",
             "Kipling, 2,sunday,abc,3"]
    spark.sparkContext.parallelize(lines, 1).saveAsTextFile(path)
    df = read_observations_csv(spark, path)
    assert df.columns == ["station", "line", "day", "hour", "riders"]
    rows = df.collect()
    assert rows[0]["station"] == "  Union " and rows[0]["line"] == "1"
    assert rows[1]["line"] is None and rows[1]["day"] is None and rows[1]["riders"] is None
    assert rows[2]["line"] == " 2" and rows[2]["hour"] == "abc"
    assert dict(df.dtypes) == {c: "string" for c in df.columns}
    assert df.filter(F.col("hour") == "24").count() == 1
