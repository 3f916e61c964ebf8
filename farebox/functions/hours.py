"""Service-hours rules (F2, F3, U1, U2, P3, P5) as ``Column`` expressions.

Two policies exist and differ on purpose:

* ``train``: weekday names open from 06:00, every other day (unknown or null)
  from 08:00, until 23:59, plus 00:00-01:30 (minute-aware).
* ``serve``: weekend names open from 08:00, every other day from 06:00,
  until 23:59, plus the whole of hours 0 and 1 (minute ignored).

Days are expected already normalised (lower-case, stripped). A null or
unparsable hour is closed under both policies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from farebox.sources.dimensions import WEEKDAYS, WEEKENDS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_weekend(day) -> Column:
    """P5: 1 for saturday/sunday, else 0 (null day gives 0)."""
    return F.coalesce(_col(day).isin(WEEKENDS), F.lit(False)).cast("int")


def train_start(day) -> Column:
    return F.when(_col(day).isin(WEEKDAYS), F.lit(6)).otherwise(F.lit(8))


def serve_start(day) -> Column:
    return F.when(_col(day).isin(WEEKENDS), F.lit(8)).otherwise(F.lit(6))


def service_open(day, hour, minute=None, policy: str = "train") -> Column:
    """F2 (train) / F3 (serve): is the system open at this day and hour."""
    d, h = _col(day), _col(hour)
    if policy == "train":
        m = F.coalesce(_col(minute), F.lit(0)) if minute is not None else F.lit(0)
        same_day = (h >= train_start(d)) & (h <= 23)
        after_midnight = (h == 0) | ((h == 1) & (m <= 30))
    elif policy == "serve":
        same_day = (h >= serve_start(d)) & (h <= 23)
        after_midnight = h.isin(0, 1)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return F.coalesce(same_day | after_midnight, F.lit(False))


def hour_24_to_0(hour) -> Column:
    """Hour 24 becomes 0; the day label is left unchanged."""
    h = _col(hour)
    return F.when(h == 24, F.lit(0)).otherwise(h)


def hours_for_daytype(day) -> Column:
    """The day's hours from its start to 23, then 0 and 1 (ordered)."""
    start = F.when(F.lower(_col(day)).isin(WEEKDAYS), F.lit(6)).otherwise(F.lit(8))
    return F.concat(F.sequence(start, F.lit(23)), F.array(F.lit(0), F.lit(1)))


def all_hours() -> Column:
    """Hours 0..23."""
    return F.sequence(F.lit(0), F.lit(23))
