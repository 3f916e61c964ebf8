"""Hold-out metrics at the edges of double arithmetic."""

import pytest

from farebox.operators.clean import clean_observations
from farebox.operators.evaluate import regression_metrics


def metrics(spark, pairs):
    return regression_metrics(spark.createDataFrame(pairs, "riders double, prediction double")).first()


@pytest.mark.parametrize("y, n", [(99.99, 1001), (1234567.89, 13), (0.1, 7)])
def test_constant_label(spark, y, n):
    row = metrics(spark, [(y, y - 1.0)] * n)
    assert (row["n"], row["r2"], row["rmse"], row["mae"]) == (n, 0.0, 1.0, 1.0)
    assert metrics(spark, [(y, y)] * n)["r2"] == 1.0


def test_near_constant_large_label_keeps_its_digits(spark):
    row = metrics(spark, [(1e8 + i / 100, 1e8 + i / 100 + 0.001) for i in range(100)])
    assert row["r2"] == pytest.approx(0.999988, abs=2e-6)


def test_missing_labels_and_empty_input(spark):
    row = metrics(spark, [(1.0, 2.0), (None, 2.0), (3.0, None), (3.0, 2.0)])
    assert (row["n"], row["r2"], row["mae"]) == (2, 0.0, 1.0)
    assert metrics(spark, [])["n"] == 0


def test_labels_are_neither_rounded_nor_dropped(spark):
    raw = spark.createDataFrame([("A", "1", "monday", "6", t) for t in
                                 ("90.126", "12345678901234567.5", "1e3", "6d", "0x1p3", "6f", "abc", " 7 ", "inf", "nan", "-.5")],
                                "station string, line string, day string, hour string, riders string")
    rows = clean_observations(raw).collect()
    assert [r["riders"] for r in rows] == [90.126, 12345678901234567.5, 1000.0, None, None, None, None, 7.0, float("inf"), None, -0.5]
    assert all(r["obs_id"] is not None for r in rows)


def test_text_and_missing_ids_get_a_stable_identity(spark):
    rows = [("7", "A"), ("seven", "A"), (None, "A"), (None, "B"), (None, "B")]
    raw = spark.createDataFrame(rows, "obs_id string, station string").selectExpr(
        "*", "'1' line", "'monday' day", "'6' hour", "'5' riders")
    ids = [r["obs_id"] for r in clean_observations(raw).collect()]
    again = [r["obs_id"] for r in clean_observations(raw.repartition(3)).collect()]
    assert ids[0] == 7 and ids[1] == ids[2] != ids[3] == ids[4] and sorted(ids) == sorted(again)
