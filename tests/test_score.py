"""Request parsing, validation and guarded scoring properties."""

from farebox.operators.baseline import fit_baseline
from farebox.operators.score import parse_records, score, validate

TRAIN = [(1, "Union", "1", "monday", 6.0, 0, 0, 100.0), (2, "Union", "1", "monday", 6.0, 0, 0, 50.0),
         (3, "Bay", "2", "sunday", 9.0, 0, 1, 10.0)]


def _model(spark):
    df = spark.createDataFrame(TRAIN, "obs_id long, station string, line string, day string, "
                                      "hour double, minute int, is_weekend int, riders double")
    return fit_baseline(df.selectExpr("*", "cast(riders as decimal(18,2)) as r").drop("riders")
                        .withColumnRenamed("r", "riders"))


def test_one_or_many_records(spark):
    req = spark.createDataFrame([
        (1, '{"records": {"station": "Union", "line": "1", "day": "Monday", "hour": 6}}'),
        (2, '{"records": [{"station": " Bay ", "line": "2", "day": "SUNDAY ", "hour": "9"},'
            ' {"station": "Bay", "line": "2", "day": "sunday", "hour": 3}]}'),
        (3, '{"records": []}'),
        (4, '{"records": ['),
        (5, '{"records": [{"line": "1", "day": "monday", "hour": 6},'
            ' {"station": "X", "line": "1", "day": "monday", "hour": 6.5}]}'),
    ], "request_id long, body string")
    checked = validate(parse_records(req))
    rejected = {(r["request_id"], r["pos"], r["reason"])
                for r in checked.filter("reason is not null").collect()}
    assert rejected == {(4, -1, "invalid body"), (5, 0, "missing station"),
                        (5, 1, "hour is not an integer")}
    valid = checked.filter("reason is null")
    out = score(valid, _model(spark), "v-test").orderBy("request_id", "pos").collect()
    # output rows = valid input rows, order keys kept
    assert [(r["request_id"], r["pos"]) for r in out] == [(1, 0), (2, 0), (2, 1)]
    assert out[0]["riders"] == 75.0 and out[0]["day"] == "monday"
    assert out[1]["station"] == "Bay" and out[1]["day"] == "sunday" and out[1]["riders"] == 10.0
    # closed (sunday 03:00, serve policy) -> exactly 0.0
    assert out[2]["riders"] == 0.0
    assert {r["model_version"] for r in out} == {"v-test"}


def test_strict_rejects_out_of_range(spark):
    req = spark.createDataFrame([(1, '{"records": {"station": "A", "line": "1", "day": "x", "hour": 24}}')],
                                "request_id long, body string")
    assert validate(parse_records(req)).first()["reason"] is None
    assert validate(parse_records(req), strict=True).first()["reason"] == "hour out of range"
