"""The shared front half of most queries: raw -> clean -> service hours -> split.

Each call starts from the raw rows; nothing is shared across queries. Queries
of several passes (split-cut search, model fit, scoring) write the cleaned
observations once to the shared checkpoint folder and scan that table
afterwards; queries of one pass read the raw rows directly, with the columns
that they need. Actions taken here return only a few numbers or at most a few
thousand small rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators.baseline import BaselineModel, fit_baseline
from farebox.operators.clean import clean_observations
from farebox.operators.service_hours import mask_metrics, service_filter
from farebox.operators.split import exact_split_sized
from farebox.session import materialize
from farebox.sources.observations import raw_observations

# Fixed training timestamp for the model version stamp in checked queries.
TRAINED_AT = "2024-02-01 12:46:00"


@dataclass
class Prepared:
    obs: DataFrame              # cleaned, null hours dropped
    n_open: int                 # open rows, observed while storing ``obs``

    @cached_property
    def kept(self) -> DataFrame:
        """Service-hours filter applied."""
        return service_filter(self.obs, n_open=self.n_open)

    @cached_property
    def _split_sized(self) -> tuple[DataFrame, int, int]:
        return exact_split_sized(self.kept)

    @property
    def split(self) -> DataFrame:
        """``kept`` with ``is_test`` (the cut search runs on first use)."""
        return self._split_sized[0]

    @property
    def sizes(self) -> tuple[int, int]:
        """(n_train, n_test), known from the cut search."""
        _, total, n_test = self._split_sized
        return total - n_test, n_test

    @property
    def train(self) -> DataFrame:
        return self.split.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.split.filter(F.col("is_test"))


def prepare(spark: SparkSession, sf_dir: str) -> Prepared:
    obs = clean_observations(raw_observations(spark, sf_dir))
    staged, counts = materialize(spark, obs, "clean-observations", mask_metrics(obs))
    return Prepared(staged, counts["n_open"])



def baseline(prep: Prepared) -> BaselineModel:
    """The baseline fitted on the train part."""
    return fit_baseline(prep.train)
