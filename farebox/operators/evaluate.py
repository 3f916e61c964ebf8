"""Hold-out metrics: A4, K4.

One aggregate pass. R² is ``1 - SSres / SStot`` (not the squared
correlation). SStot is n times the label's population variance, which Spark
merges from running means and never as a difference of large sums, so a label
of little spread keeps its digits. A constant label (smallest = largest)
gives R² = 1 when every residual is 0 and 0 otherwise. Derived floats are
rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def regression_metrics(df: DataFrame, label: str = "riders",
                       prediction: str = "prediction") -> DataFrame:
    """One row: n, r2, rmse, mae over rows with both label and prediction."""
    y, p = F.col(label), F.col(prediction)
    resid = y.cast("double") - p
    sums = (df.filter(y.isNotNull() & p.isNotNull())
            .agg(F.count(F.lit(1)).alias("n"),
                 F.var_pop(y.cast("double")).alias("variance"),
                 (F.min(y) == F.max(y)).alias("constant"),
                 F.sum(resid * resid).alias("sse"),
                 F.sum(F.abs(resid)).alias("sae")))
    n = F.col("n")
    r2 = (F.when(F.col("constant"), F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("sse") / (F.col("variance") * n)))
    # "+ 0.0" turns a rounded -0.0 into 0.0 (engines differ on its sign).
    return sums.select(
        n.alias("n"),
        (F.round(r2, DIGITS) + F.lit(0.0)).alias("r2"),
        (F.round(F.sqrt(F.col("sse") / n), DIGITS) + F.lit(0.0)).alias("rmse"),
        (F.round(F.col("sae") / n, DIGITS) + F.lit(0.0)).alias("mae"),
    )
