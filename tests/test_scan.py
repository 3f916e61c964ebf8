"""Two-level scans: forward fill (J6) and exact order statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from farebox.operators import scan
from farebox.plans import QUERIES


@pytest.mark.parametrize("gap", [0.0, 0.5, 0.97, 1.0])
def test_forward_fill_equals_one_pass(spark, gap):
    rng = random.Random(gap)
    rows = [(i // 24, i % 24, None if rng.random() < gap else f"v{i}") for i in range(2000)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "day int, hour int, v string").repartition(6)
    last, want = None, []
    for day, hour, v in rows:
        last = v if v is not None else last
        want.append((day, hour, last))
    assert sorted(tuple(r) for r in scan.forward_fill(df, ["day", "hour"], "v").collect()) == want


def test_forward_fill_of_structs_and_nothing(spark):
    df = spark.createDataFrame([(1, ("a", 1.0)), (2, None), (3, ("b", None)), (4, None)], "k int, v struct<t:string,x:double>")
    got = {r["k"]: r["v"] and tuple(r["v"]) for r in scan.forward_fill(df, ["k"], "v").collect()}
    assert got == {1: ("a", 1.0), 2: ("a", 1.0), 3: ("b", None), 4: ("b", None)}
    assert scan.forward_fill(df.where("k > 9"), ["k"], "v").count() == 0


def test_fusion_has_no_single_task_window(spark, small_dir):
    df = QUERIES["fused_observations"](spark, small_dir)
    df.collect()
    assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("boundary", [1, 50, 10 ** 6])
def test_order_statistics_equal_sorting(spark, monkeypatch, boundary):
    monkeypatch.setattr(scan, "BOUNDARY_ROWS", boundary)
    monkeypatch.setattr(scan, "BUCKETS", 7)
    rng = random.Random(boundary)
    kinds = [[rng.gauss(0, 1) for _ in range(900)], [5.0] * 700, [float(rng.randrange(4)) for _ in range(500)],
             [rng.choice([1e300, -1e300, 1e-300, 0.0, 3.0]) for _ in range(400)], [math.inf] * 3 + [-math.inf] * 4 + [1.0, 2.0, 2.5], [-0.0, 0.0, 1.0]]
    shares = [0.0, 1 / 3, 0.5, 2 / 3, 0.999, 1.0]
    for values in kinds:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double").repartition(5)
        ordered = sorted(values)
        want = [ordered[k - 1] for k in scan.ranks_of(shares, len(values))]
        assert scan.order_statistics(df, "x", shares) == want
    assert scan.order_statistics(spark.createDataFrame([], "x double"), "x", [0.5]) is None


def test_order_statistics_agree_with_percentile(spark):
    df = spark.range(10007).select((F.xxhash64("id") % 1000 / 7).alias("x"))
    shares = [0.01, 1 / 3, 2 / 3, 0.9]
    want = df.agg(*[F.expr(f"percentile_disc({q!r}D) WITHIN GROUP (ORDER BY x)") for q in shares]).first()
    assert scan.order_statistics(df, "x", shares) == list(want)
