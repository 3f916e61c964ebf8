"""Split: exact size, brute-force equality, partition independence."""

import hashlib
import math

import pytest

from farebox.operators import split as split_mod


def brute_force_test_ids(ids, share=0.2, seed=42):
    keyed = sorted((hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i) for i in ids)
    n_test = math.ceil(share * len(ids))
    return {i for _, i in keyed[:n_test]}


@pytest.mark.parametrize("n", [1, 7, 15, 1000, 5003])
def test_exact_split_matches_brute_force(spark, n):
    df = spark.range(n).withColumnRenamed("id", "obs_id")
    got = {r[0] for r in split_mod.exact_split(df).filter("is_test").select("obs_id").collect()}
    assert got == brute_force_test_ids(range(n))


def test_refinement_levels_match_brute_force(spark, monkeypatch):
    # A tiny boundary bound forces several refinement levels.
    monkeypatch.setattr(split_mod, "BOUNDARY_ROWS", 2)
    monkeypatch.setattr(split_mod, "PREFIX_STEP", 1)
    df = spark.range(3000).withColumnRenamed("id", "obs_id")
    got = {r[0] for r in split_mod.exact_split(df).filter("is_test").select("obs_id").collect()}
    assert got == brute_force_test_ids(range(3000))


def test_split_independent_of_partitioning(spark):
    df = spark.range(4000).withColumnRenamed("id", "obs_id")
    a = split_mod.exact_split(df.repartition(1)).filter("is_test").select("obs_id")
    b = split_mod.exact_split(df.repartition(13)).filter("is_test").select("obs_id")
    assert sorted(a.collect()) == sorted(b.collect())
    c = split_mod.bucket_split(df.repartition(3)).filter("is_test").select("obs_id")
    d = split_mod.bucket_split(df.repartition(11)).filter("is_test").select("obs_id")
    assert sorted(c.collect()) == sorted(d.collect())


def test_bucket_split_rule(spark):
    df = spark.range(500).withColumnRenamed("id", "obs_id")
    got = {r[0] for r in split_mod.bucket_split(df).filter("is_test").select("obs_id").collect()}
    want = {i for i in range(500)
            if int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16) % 100 < 20}
    assert got == want


def test_empty_and_tiny(spark):
    empty = spark.range(0).withColumnRenamed("id", "obs_id")
    assert split_mod.exact_split(empty).count() == 0
    one = spark.range(1).withColumnRenamed("id", "obs_id")
    assert split_mod.exact_split(one).filter("is_test").count() == 1  # ceil(0.2) = 1
