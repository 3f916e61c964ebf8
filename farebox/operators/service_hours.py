"""Service-hours filtering and reports: F2-F5, A3, A5, G5, P8.

The open test is a plain boolean ``Column`` (see ``functions.hours``), so the
filter runs inside the scan's codegen stage. The empty-mask fallback (F4)
needs to know whether any row is open: one action that stops at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.functions.hours import all_hours, service_open


def open_column(df: DataFrame, policy: str = "train"):
    minute = "minute" if "minute" in df.columns else None
    return service_open("day", "hour", minute, policy)


def mask_counts(obs: DataFrame) -> DataFrame:
    """A3: rows before the mask, open rows, and rows kept after the fallback."""
    is_open = open_column(obs)
    in_range = F.col("hour").between(0, 23)
    agg = obs.agg(F.count(F.lit(1)).alias("n_before"),
                  F.count_if(is_open).alias("n_open"),
                  F.count_if(in_range).alias("n_in_range"))
    return agg.select(
        "n_before", "n_open",
        F.when(F.col("n_open") > 0, F.col("n_open")).otherwise(F.col("n_in_range")).alias("n_after"),
        (F.col("n_open") == 0).alias("fallback_used"))


def mask_metrics(obs: DataFrame, policy: str = "train") -> list:
    """The A3 counts as aggregate expressions, for ``DataFrame.observe``."""
    return [F.count(F.lit(1)).alias("n_before"),
            F.count_if(open_column(obs, policy)).alias("n_open"),
            F.count_if(F.col("hour").between(0, 23)).alias("n_in_range")]


def service_filter(obs: DataFrame, policy: str = "train", n_open: int | None = None) -> DataFrame:
    """F2 + F4: keep open rows; if none is open, keep hours 0..23 instead.

    ``n_open`` may be passed when already known (e.g. observed while the
    observations were written); otherwise one action looks for an open row. It ends at the
    first one found, so the input is read whole only where none is open.
    """
    is_open = open_column(obs, policy)
    some = n_open > 0 if n_open is not None else not obs.filter(is_open).isEmpty()
    return obs.filter(is_open) if some else obs.filter(F.col("hour").between(0, 23))


def require_rows(df: DataFrame) -> DataFrame:
    """fail when nothing is left."""
    if df.isEmpty():
        raise RuntimeError(
            "No rows left after hour parsing and the service-hours filter; "
            "check the hour column of the input.")
    return df


def open_hours(filtered: DataFrame) -> DataFrame:
    """A5: distinct hours present among kept rows, ascending."""
    return filtered.select("hour").distinct().orderBy("hour")


def service_hours_by_day(obs: DataFrame) -> DataFrame:
    """For every day label found in the data, the hours 0..23 open under
    each policy. Distinct days are few, so the 24-fold explode is cheap."""
    days = obs.select("day").where(F.col("day").isNotNull()).distinct()
    grid = days.select("day", F.explode(all_hours()).alias("hour"))
    return grid.select(
        "day", "hour",
        service_open("day", "hour", None, "train").alias("open_train"),
        service_open("day", "hour", None, "serve").alias("open_serve"),
    ).filter(F.col("open_train") | F.col("open_serve"))
