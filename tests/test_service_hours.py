"""Edge table for the two service-hours policies and the cleaning rules."""


from farebox.functions.hours import hour_24_to_0, service_open
from farebox.functions.text import norm_day, null_tokens, strip, to_number
from farebox.operators.clean import clean_observations

# (day, hour text, minute, train open, serve open); train is applied after 24 -> 0.
EDGES = [
    ("monday", "5", 0, False, False),
    ("monday", "6", 0, True, True),
    ("saturday", "7", 0, False, False),
    ("saturday", "8", 0, True, True),
    ("sunday", "23", 59, True, True),
    ("monday", "0", 0, True, True),
    ("monday", "1", 30, True, True),
    ("monday", "1", 31, False, True),
    ("monday", "2", 0, False, False),
    ("monday", "24", 0, True, False),
    ("monday", "-1", 0, False, False),
    ("monday", "50", 0, False, False),
    ("holiday", "6", 0, False, True),
    ("holiday", "8", 0, True, True),
    (None, "7", 0, False, None),
    ("monday", "abc", 0, False, None),
    ("monday", "6.5", 0, True, None),
    ("monday", "0.5", 0, False, None),
    ("monday", "7", None, True, True),
]


def test_edge_table_both_policies(spark):
    df = spark.createDataFrame(EDGES, "day string, hour string, minute int, "
                                      "exp_train boolean, exp_serve boolean")
    h = to_number("hour")
    out = df.select(
        "day", "hour", "minute", "exp_train", "exp_serve",
        service_open("day", hour_24_to_0(h), "minute", "train").alias("train"),
        service_open("day", h, None, "serve").alias("serve")).collect()
    for r in out:
        assert r["train"] == r["exp_train"], r
        if r["exp_serve"] is not None:  # None: rejected by validation before the test
            assert r["serve"] == r["exp_serve"], r


def test_text_normalisation(spark):
    df = spark.createDataFrame([(" MONDAY ",), ("Monday\t",), ("  Station 3 ",), (" 2",),
                                ("2 ",), ("NA",), ("n/a",), ("",), (None,)], "v string")
    out = [tuple(r) for r in df.select(norm_day("v"), strip("v"), null_tokens("v")).collect()]
    assert out[0][:2] == ("monday", "MONDAY")
    assert out[1][:2] == ("monday", "Monday")
    assert out[2][1] == "Station 3"
    assert out[3][1] == "2" and out[4][1] == "2"
    assert out[5][2] is None and out[6][2] is None and out[7][2] is None


def test_to_number_coerces(spark):
    df = spark.createDataFrame([("abc",), (" 6 ",), ("NaN",), ("24",)], "v string")
    got = [r[0] for r in df.select(to_number("v")).collect()]
    assert got == [None, 6.0, None, 24.0]


def test_clean_drops_null_hours_and_maps_24(spark):
    raw = spark.createDataFrame(
        [(1, " A ", " 1", " MONDAY ", "24", "10.50", "2024-01-01"),
         (2, "B", "2", "sunday", None, "3", "2024-01-07"),
         (3, "C", "NA", "Holiday", "abc", "1", None),
         (4, None, "4", None, "7", None, None)],
        "obs_id long, station string, line string, day string, hour string, riders string, "
        "date string").select("obs_id", *[null_tokens(c).alias(c) for c in
                                          ("station", "line", "day", "hour", "riders", "date")])
    rows = {r["obs_id"]: r for r in clean_observations(raw).collect()}
    assert set(rows) == {1, 4}
    assert (rows[1]["station"], rows[1]["line"], rows[1]["day"], rows[1]["hour"]) == ("A", "1", "monday", 0.0)
    assert rows[1]["is_weekend"] == 0 and rows[1]["minute"] == 0
    assert float(rows[1]["riders"]) == 10.5
    assert rows[4]["day"] is None and rows[4]["is_weekend"] == 0 and rows[4]["riders"] is None
