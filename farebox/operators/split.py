"""Reproducible train/test split: M1.

Rows are ordered by a per-row key ``md5("<seed>|<row id>")``; the key
depends only on the row identity, so the split is the same whatever the
partitioning or file layout (``randomSplit`` is not).

* ``bucket_split``: test when the key's leading 32 bits mod 100 fall below
  the test share; a pure row expression, no shuffle.
* ``exact_split``: exactly ``ceil(share * n)`` test rows, the rows with the
  smallest (key, id). Rows that share an id stay on one side, so an id that
  many rows share can make the test part larger. No global sort and no single-partition window: the
  cut point is found by histogram refinement over key prefixes. Each level
  is one grouped count over at most 4,096 prefixes (collected: 4,096 small
  rows), narrowing the boundary by 4,096x; once the boundary bucket holds at
  most ``BOUNDARY_ROWS`` rows its keys are collected and the cut is read
  off. About 1e12 rows need two levels (1e12 / 4096² ≈ 6e4 boundary rows).
  The split itself is then one row predicate ``(key, id) <= cut``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
TEST_SHARE = 0.2
PREFIX_STEP = 3          # hex digits added per refinement level (4,096 buckets)
BOUNDARY_ROWS = 65_536   # collect the boundary bucket once it is this small


def split_key(id_col: str = "obs_id", seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def hash_bucket(key: Column) -> Column:
    """Leading 8 hex digits of the key as a number, mod 100."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def bucket_split(df: DataFrame, id_col: str = "obs_id", test_share: float = TEST_SHARE,
                 seed: int = SEED) -> DataFrame:
    """Approximate share, no action, no shuffle."""
    threshold = int(round(test_share * 100))
    return df.withColumn("is_test", hash_bucket(split_key(id_col, seed)) < threshold)


def n_test_for(n: int, test_share: float = TEST_SHARE) -> int:
    """Test size as a float product rounded up (same arithmetic as the reference)."""
    return int(math.ceil(test_share * n))


def _find_cut(df: DataFrame, id_col: str, seed: int, test_share: float):
    """(key, id) of the last test row, or None when no cut is needed; n; the test size."""
    keyed = df.select(split_key(id_col, seed).alias("_k"), F.col(id_col).alias("_id"))
    prefix, need, total = "", 0, None
    while True:
        width = len(prefix) + PREFIX_STEP
        region = keyed if not prefix else keyed.filter(F.col("_k").startswith(prefix))
        hist = sorted(tuple(r) for r in
                      region.groupBy(F.substring("_k", 1, width).alias("b")).count().collect())
        if total is None:
            # The first level's histogram also yields the row count.
            total = sum(c for _, c in hist)
            need = n_test_for(total, test_share)
            if need <= 0 or need >= total:
                return None, total, (total if need > 0 else 0)
        cum = 0
        for bucket, count in hist:
            if cum + count >= need:
                break
            cum += count
        need -= cum
        if count <= BOUNDARY_ROWS:
            rows = sorted(tuple(r) for r in
                          region.filter(F.col("_k").startswith(bucket)).collect())
            cut = rows[need - 1]
            return cut, total, n_test_for(total, test_share) + sum(r <= cut for r in rows) - need
        if width >= 32:                # one key: the rows of one id, all of them in the test part
            cut = tuple(region.filter(F.col("_k") == bucket).orderBy(F.desc("_id")).first())
            return cut, total, n_test_for(total, test_share) + count - need
        prefix = bucket


def exact_split_sized(df: DataFrame, id_col: str = "obs_id", test_share: float = TEST_SHARE,
                      seed: int = SEED) -> tuple[DataFrame, int, int]:
    """``exact_split`` plus the row count and test size, known from the cut
    search (no extra pass)."""
    cut, total, n_test = _find_cut(df, id_col, seed, test_share)
    if cut is None:
        return df.withColumn("is_test", F.lit(0 < total == n_test)), total, n_test
    cut_key, cut_id = cut
    k = split_key(id_col, seed)
    is_test = (k < F.lit(cut_key)) | ((k == F.lit(cut_key)) & (F.col(id_col) <= F.lit(cut_id)))
    return df.withColumn("is_test", is_test), total, n_test


def exact_split(df: DataFrame, id_col: str = "obs_id", test_share: float = TEST_SHARE,
                seed: int = SEED) -> DataFrame:
    """Exactly ceil(share * n) test rows (smallest split keys); adds ``is_test``."""
    return exact_split_sized(df, id_col, test_share, seed)[0]
