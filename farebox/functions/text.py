"""Text normalisation as JVM-side ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens a pandas CSV read treats as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Leading or trailing Unicode whitespace (Python ``str.strip`` semantics).
# ``trim`` only removes spaces, so tabs and other blanks would survive it.
_EDGE_BLANKS = r"(?U)\A\s+|\s+\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing whitespace, keep case."""
    return F.regexp_replace(_col(c), _EDGE_BLANKS, "")


def norm_day(c) -> Column:
    """Lower-case then strip."""
    return strip(F.lower(_col(c)))


def null_tokens(c) -> Column:
    """Missing-value tokens become null (note k)."""
    c = _col(c)
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


# A decimal number or infinity. Spark's cast alone would also take Java's
# suffixes and hexadecimal floats ("6d", "0x1p3").
NUMBER = r"(?i)^\s*([+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity))\s*$"


def is_number(c) -> Column:
    """Whether ``to_number`` gives a value: a test of the text itself, which no
    missing-value token passes."""
    return F.coalesce(_col(c).cast("string").rlike(NUMBER), F.lit(False))


def to_number(c) -> Column:
    """Numeric coercion; unparsable text and NaN become null. Names its argument
    once: a planner that inlines it doesn't multiply the expression behind it."""
    return F.regexp_extract(_col(c).cast("string"), NUMBER, 1).try_cast("double")
