"""Small literal tables built inside the JVM.

``createDataFrame`` on a Python list becomes a Python-RDD scan, which
starts Python workers in every job that reads it. An inline ``VALUES``
table is a local relation instead: planned as a ``LocalTableScan`` and
broadcast without any Python process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a DataFrame with DDL ``schema`` (``"a int, b string"``)."""
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    names = [n for n, _ in fields]
    cols = ", ".join(f"c{i}" for i in range(len(names)))
    values = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST(c{i} AS {t}) AS `{n}`" for i, (n, t) in enumerate(fields))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({cols})")
