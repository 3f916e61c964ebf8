"""Inputs as the reference's users have them, and that no input row is lost."""

from pyspark.sql import functions as F

from farebox.operators.context import event_listings, hourly_weather, weather_readings
from farebox.operators.score import parse_records, validate
from farebox.operators.split import exact_split_sized
from farebox.plans.jobs import main
from farebox.session import scratch_path
from farebox.sources.observations import read_observations_csv
from farebox.sources.payloads import events_payload_standin, weather_standin
from farebox.sources.requests import read_request_bodies, request_standin

SAMPLE = '{\n "records": {\n  "station": "Union",\n  "line": "1",\n  "day": "Monday",\n  "hour": 6\n }\n}'


def checked(spark, bodies):
    frame = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    return {(r["request_id"], r["pos"]): (r["reason"], r["hour"]) for r in validate(parse_records(frame)).collect()}


def test_records_are_judged_one_by_one_on_json_types(spark):
    def rec(**change):
        import json
        return json.dumps({**{"station": "Union", "line": "1", "day": "monday", "hour": 6}, **change})
    got = checked(spark, [
        '{"records":[' + rec() + ']} trailing', '{"records":[' + rec() + ', 7, null, [1]]}', '{"records":' + rec(station=5) + '}',
        '{"records":' + rec(line=1) + '}', '{"records":' + rec(station={"x": 1}) + '}', '{"records":' + rec(hour="6d") + '}',
        '{"records":' + rec(hour="1e1") + '}', '{"records":' + rec(hour=" 7 ") + '}', '{"records":' + rec(hour=8.0) + '}',
        '{"records":' + rec(hour=8.5) + '}', '{"records":' + rec(day=None) + '}', '{"records": 7}', '{"records": "x"}', "[]", "", None,
        '{"records":' + rec(hour=True) + '}', SAMPLE, '{"records":' + rec(hour=99999999999) + '}'])
    bad, obj = ("invalid body", None), ("record is not an object", None)
    assert got == {(0, -1): bad, (1, 0): (None, 6), (1, 1): obj, (1, 2): obj, (1, 3): obj, (2, 0): ("station is not text", 6),
                   (3, 0): ("line is not text", 6), (4, 0): ("station is not text", 6), (5, 0): ("hour is not an integer", None),
                   (6, 0): ("hour is not an integer", None), (7, 0): (None, 7), (8, 0): (None, 8), (9, 0): ("hour is not an integer", None),
                   (10, 0): ("missing day", 6), (11, -1): bad, (12, -1): bad, (13, -1): bad, (14, -1): bad, (15, -1): bad,
                   (16, 0): (None, 1), (17, 0): (None, 6), (18, 0): ("hour is not an integer", None)}


def test_every_event_reaches_the_standins(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    n = events.count()
    assert weather_readings(weather_standin(events)).count() == n
    assert event_listings(events_payload_standin(spark, events)).select("event_id").distinct().count() == n
    requests = request_standin(spark, events)
    assert requests.select("request_id").distinct().count() == requests.count()
    records = validate(parse_records(requests.where("request_id >= 0")))
    assert records.count() == n and records.where("reason is null").count() + records.where("reason is not null").count() == n


def test_jobs_on_the_references_own_files(spark, tmp_path):
    csv, bodies = tmp_path / "obs.csv", tmp_path / "bodies"
    lines = ["Station, Line, Day, Hour, Riders".replace(", ", ",")]
    for i in range(60):
        lines.append(f'"Queen ""X"" St",{1 + i % 2}, Monday ,{6 + i % 12},{100 + i}.5')
    csv.write_text("\n".join(lines) + "\n")
    assert read_observations_csv(spark, str(csv)).first()["station"] == 'Queen "X" St'
    bodies.mkdir()
    (bodies / "one.json").write_text(SAMPLE)
    (bodies / "two.json").write_text('{"records": [7]}')
    assert read_request_bodies(spark, str(bodies)).count() == 2
    model, out = str(tmp_path / "model"), str(tmp_path / "out")
    main(["train", "--csv", str(csv), "--out", model, "--algo", "linear"])
    main(["score", "--model", model, "--requests", str(bodies), "--out", out, "--bodies"])
    assert [(r["station"], r["hour"]) for r in spark.read.parquet(f"{out}/scored").collect()] == [("Union", 6)]
    assert [r["reason"] for r in spark.read.parquet(f"{out}/rejected").collect()] == ["record is not an object"]


def test_rows_sharing_an_id_stay_together(spark, monkeypatch):
    from farebox.operators import split as split_mod
    monkeypatch.setattr(split_mod, "BOUNDARY_ROWS", 5)
    frame = spark.range(100).select(F.when(F.col("id") < 60, F.lit(1)).otherwise(F.col("id")).alias("obs_id"))
    out, total, n_test = exact_split_sized(frame)
    assert total == 100 and out.where("is_test").count() == n_test
    assert out.where("obs_id = 1").select("is_test").distinct().count() == 1


def test_weather_is_never_ahead_and_crosses_midnight(spark):
    readings = spark.createDataFrame([("2024-01-01 06:59:00", 1.0, "a"), ("2024-01-02 03:00:00", 2.0, "b")],
                                     "t string, temp_c double, condition string").selectExpr("to_timestamp(t) fetched_at", "temp_c", "condition")
    dates = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-04",), (None,)], "d string").selectExpr("cast(d as date) service_date")
    got = {(str(r["service_date"]), r["hour"]): r["temp_c"] for r in hourly_weather(readings, dates).collect()}
    assert [got[("2024-01-01", h)] for h in (0, 6, 7, 23)] == [None, None, 1.0, 1.0]
    assert [got[("2024-01-02", h)] for h in (0, 2, 3, 23)] == [1.0, 1.0, 2.0, 2.0]
    assert got[("2024-01-04", 0)] == 2.0


def test_scratch_is_removed_when_the_application_ends(spark):
    from farebox.session import materialize, remove_now
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    remove_now(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    assert materialize(spark, spark.range(3), "kept").count() == 3
