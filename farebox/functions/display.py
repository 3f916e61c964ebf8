"""Time features and display formatting: P13-P18, P21, P22.

Column expressions, but for ``to_fixed``, which formats the literals of the
fixed station table on the driver.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weekday_name(ts) -> Column:
    """Weekday name (English, session time zone)."""
    return F.date_format(_col(ts), "EEEE")


def round_half_up(x) -> Column:
    """JavaScript ``Math.round``: nearest integer, ties toward +infinity.
    ``x - floor(x)`` is exact in double arithmetic, unlike ``floor(x + 0.5)``."""
    x = _col(x)
    fl = F.floor(x)
    return F.when(x - fl >= 0.5, fl + 1).otherwise(fl)


def js_riders_text(x) -> Column:
    """``Math.round(x).toLocaleString()`` (en-US thousands separators)."""
    return F.format_number(round_half_up(x).cast("double"), 0)


def py_riders_text(x) -> Column:
    """``f"{x:,.0f}"`` (half-even on the exact value)."""
    return F.format_number(_col(x).cast("double"), 0)


def version_stamp(ts) -> Column:
    """``v%Y.%m.%d.%H%M``."""
    return F.date_format(_col(ts), "'v'yyyy.MM.dd.HHmm")


def title_day(day) -> Column:
    """Title-case day label."""
    return F.initcap(_col(day))


def none_text(c) -> Column:
    """Python's rendering of a possibly-missing value inside an f-string."""
    return F.coalesce(_col(c).cast("string"), F.lit("None"))


def event_line(date, time, name, venue, lat, lon) -> Column:
    """``{date} {time} — {name} @ {venue} ({lat},{lon})``."""
    return F.concat(none_text(date), F.lit(" "), none_text(time), F.lit(" — "),
                    none_text(name), F.lit(" @ "), none_text(venue), F.lit(" ("),
                    none_text(lat), F.lit(","), none_text(lon), F.lit(")"))


def parse_clock(text) -> tuple[Column, Column]:
    """P21 (our semantics): hour and minute from "3:34 PM", "15:34" or a
    range such as "6–7 a.m." (the range's start hour, minute 0)."""
    t = F.trim(_col(text))
    ts = F.coalesce(F.try_to_timestamp(t, F.lit("h:mm a")), F.try_to_timestamp(t, F.lit("H:mm")))
    rng = r"^(\d{1,2})\s*[-–]\s*(\d{1,2})\s*([ap])\.?\s*m\.?$"
    start = F.regexp_extract(F.lower(t), rng, 1)
    ampm = F.regexp_extract(F.lower(t), rng, 3)
    start_i = F.when(start != "", start.cast("int"))
    range_hour = (F.when(ampm == "a", F.when(start_i == 12, F.lit(0)).otherwise(start_i))
                  .when(ampm == "p", F.when(start_i == 12, F.lit(12)).otherwise(start_i + 12)))
    valid_range = start_i.between(1, 12)
    hour = F.coalesce(F.hour(ts), F.when(valid_range, range_hour))
    minute = F.coalesce(F.minute(ts), F.when(valid_range, F.lit(0)))
    return hour, minute


def minute_of_day(hour, minute) -> Column:
    """Hour * 60 + minute."""
    return _col(hour) * 60 + _col(minute)


def tod_sin(mod) -> Column:
    return F.sin(F.lit(TWO_PI) * _col(mod) / 1440)


def tod_cos(mod) -> Column:
    return F.cos(F.lit(TWO_PI) * _col(mod) / 1440)


def to_fixed(x: float, digits: int = 4) -> str:
    """JavaScript ``x.toFixed(digits)`` (exact binary value, ties away from
    zero), for the literals of a fixed table. Spark's formatters round the
    shortest decimal form instead (43.64545 gives 43.6455, a browser 43.6454)."""
    text = f"{Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP):f}"
    return text[1:] if x == 0 and text.startswith("-") else text     # -0.0 prints without a sign
