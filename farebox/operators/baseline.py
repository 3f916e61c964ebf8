"""SQL-checkable baseline predictor: M10 (with the M2 categorical fill).

It stands in for the boosted-tree model at the same interface (``fit`` on
the train part, ``predict`` adds a ``prediction`` column) so that the split,
metrics, scoring and profiles can be checked exactly against SQL.

* fill: null station / line / day -> that column's mode on the train part
  (ties: smallest), as the reference pipeline's most-frequent imputer does
* prediction: mean riders of the train rows with the same (station, line,
  day, hour); the global train mean where that cell was never seen

Means are sums of doubles by counts; queries round what they derive from them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.operators.aggregates import most_frequent
from farebox.session import materialize

CATEGORICAL = ["station", "line", "day"]
CELL = ["station", "line", "day", "hour"]


def categorical_modes(train: DataFrame, columns=CATEGORICAL) -> dict:
    """Every column's mode in one pass (long form, grouped by column)."""
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns
    ])).alias("kv")).select("kv.col", "kv.val")
    found = {r["col"]: r["val"] for r in most_frequent(long, "val", ["col"]).collect()}
    return {c: found.get(c) for c in columns}


def fill_categorical(df: DataFrame, fills: dict) -> DataFrame:
    cols = []
    for name in df.columns:
        if name in fills and fills[name] is not None:
            cols.append(F.coalesce(F.col(name), F.lit(fills[name])).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


@dataclass
class BaselineModel:
    fills: dict
    global_mean: float | None
    means: DataFrame  # station, line, day, hour, cell_mean
    cells: DataFrame | None = None  # every filled train cell (stored), labelled or not

    def combinations(self) -> DataFrame:
        """Distinct filled (station, line, day) of the train part, read from
        the stored cell table instead of another pass over the rows."""
        return self.cells.select("station", "line", "day").distinct()

    def vocabulary(self) -> DataFrame:
        """Filled training categories in long form (feature, value)."""
        return (self.cells.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
            for c in CATEGORICAL])).alias("kv")).select("kv.feature", "kv.value")
            .where(F.col("value").isNotNull()).distinct())

    def impute(self, df: DataFrame) -> DataFrame:
        return fill_categorical(df, self.fills)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        filled = self.impute(df)
        joined = filled.join(self.means, CELL, "left")
        pred = F.coalesce(F.col("cell_mean"), F.lit(self.global_mean).cast("double"))
        return joined.withColumn(out, pred).drop("cell_mean")


def fit_baseline(train: DataFrame, label: str = "riders") -> BaselineModel:
    """One grouped pass over the train part, then work on a bounded table.

    Rows are grouped on the raw cell keys (a null key is its own group) with
    the row count, the label sum and the label count. The
    categorical modes come from that table (row counts summed per value), the
    null keys are then filled and the table re-aggregated: the same cells and
    means as filling every row first, without a second pass over the data.
    """
    raw_cells = (train.groupBy(*CELL)
                 .agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("cell_sum"),
                      F.count(label).alias("cell_n"))
                 .persist(StorageLevel.MEMORY_AND_DISK))
    long = raw_cells.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val"))
        for c in CATEGORICAL])).alias("kv")).select("rows", "kv.col", "kv.val")
    counted = (long.where(F.col("val").isNotNull()).groupBy("col", "val")
               .agg(F.sum("rows").alias("n")))
    found = {r["col"]: r["val"] for r in counted.groupBy("col").agg(
        F.min_by("val", F.struct((-F.col("n")).alias("neg_n"), F.col("val").alias("v")))
        .alias("val")).collect()}
    fills = {c: found.get(c) for c in CATEGORICAL}
    all_cells = materialize(train.sparkSession, fill_categorical(raw_cells, fills).groupBy(*CELL)
                            .agg(F.sum("cell_sum").alias("cell_sum"), F.sum("cell_n").alias("cell_n")), "cells")
    raw_cells.unpersist()
    cells = (all_cells.filter(F.col("cell_n") > 0)
             .withColumn("cell_mean", F.col("cell_sum").cast("double") / F.col("cell_n")))
    total = cells.agg(F.sum("cell_sum").alias("s"), F.sum("cell_n").alias("n")).first()
    global_mean = float(total["s"]) / total["n"] if total["n"] else None
    # The cell table is a small file; the planner broadcasts it by its bytes.
    return BaselineModel(fills, global_mean, cells.select(*CELL, "cell_mean"), all_cells)
