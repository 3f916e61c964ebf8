"""Display rounding and parsing rules."""

from farebox.functions.display import (js_riders_text, parse_clock, py_riders_text,
                                       round_half_up, to_fixed)


def test_js_to_fixed_uses_exact_binary_value():
    got = [to_fixed(x, 4) for x in (43.64545, -79.38658, 43.698, 0.03125, -0.0)]
    assert got == ["43.6454", "-79.3866", "43.6980", "0.0313", "0.0000"]


def test_round_half_up_and_texts(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.49999999999999994,), (1234567.5,), (3.5,)], "x double")
    rows = df.select(round_half_up("x").alias("r"), js_riders_text("x").alias("js"),
                     py_riders_text("x").alias("py")).collect()
    assert [r["r"] for r in rows] == [3, -2, 0, 1234568, 4]
    assert [r["js"] for r in rows] == ["3", "-2", "0", "1,234,568", "4"]
    assert [r["py"] for r in rows] == ["2", "-2", "0", "1,234,568", "4"]


def test_parse_clock(spark):
    df = spark.createDataFrame([("3:34 PM",), ("15:34",), ("6–7 a.m.",), ("12-1 p.m.",),
                                ("12:05 AM",), ("later",)], "t string")
    h, m = parse_clock("t")
    got = [tuple(r) for r in df.select(h, m).collect()]
    assert got == [(15, 34), (15, 34), (6, 0), (12, 0), (0, 5), (None, None)]
