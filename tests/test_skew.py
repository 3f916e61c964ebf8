"""A third of all rows on one key: results must equal a brute force."""

import math
import random

import pandas as pd
import pytest

from farebox.operators.baseline import fit_baseline
from farebox.operators.profile import combinations, profile_24h, typical_line
from farebox.operators.split import exact_split


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(9000):
        if i % 3 == 0:  # the hot key: a third of all rows
            st, ln, dy, hr = "Union", "1", "monday", 8.0
        else:
            st = f"S{rnd.randrange(40)}"
            ln = rnd.choice(["1", "2", None])
            dy = rnd.choice(["monday", "saturday", "sunday", None])
            hr = float(rnd.randrange(24))
        riders = None if i % 97 == 0 else rnd.randrange(0, 100000) / 4      # sums of quarters are exact
        rows.append((i, st, ln, dy, hr, 0, 1 if dy in ("saturday", "sunday") else 0, riders))
    pdf = pd.DataFrame(rows, columns=["obs_id", "station", "line", "day", "hour", "minute",
                                      "is_weekend", "riders"])
    df = spark.createDataFrame(rows, "obs_id long, station string, line string, day string, "
                                     "hour double, minute int, is_weekend int, "
                                     "riders double").repartition(7)
    return df, pdf


def _mode(series):
    counts = series.dropna().value_counts()
    best = counts.max()
    return min(v for v, c in counts.items() if c == best)


def test_baseline_means_exact_under_skew(skewed):
    df, pdf = skewed
    model = fit_baseline(df)
    fills = {c: _mode(pdf[c]) for c in ("station", "line", "day")}
    assert model.fills == fills
    filled = pdf.fillna(fills)
    lab = filled[filled.riders.notna()]
    want = {k: float(sum(g.riders)) / len(g)
            for k, g in lab.groupby(["station", "line", "day", "hour"])}
    got = {(r["station"], r["line"], r["day"], r["hour"]): r["cell_mean"]
           for r in model.means.collect()}
    assert got == want
    assert model.global_mean == float(sum(lab.riders)) / len(lab)
    prof = profile_24h(model, combinations(model.impute(df)))
    hot = prof.filter("station = 'Union' AND line = '1' AND day = 'monday' AND hour = 8").first()
    assert hot["riders"] == want[("Union", "1", "monday", 8.0)]


def test_typical_line_under_skew(skewed):
    df, pdf = skewed
    got = {r["station_key"]: r["line"] for r in typical_line(df).collect()}
    assert got["union"] == "1"
    for key, g in pdf.assign(k=pdf.station.str.lower()).groupby("k"):
        if g.line.notna().any():
            assert got[key] == _mode(g.line)


def test_exact_split_under_skew(skewed):
    df, pdf = skewed
    n_test = exact_split(df).filter("is_test").count()
    assert n_test == math.ceil(0.2 * len(pdf))


def test_aggregates_are_partial_before_shuffle(spark, skewed):
    df, _ = skewed
    plan = typical_line(df)._jdf.queryExecution().executedPlan().toString()
    # Partial aggregation happens below the exchange (map-side combine).
    assert "partial_min_by" in plan
