"""The ridership model: M2-M8, M11, K1, K2, P17.

A ``pyspark.ml`` Pipeline mirroring the reference's preprocessing:

* categorical columns: null -> most frequent value (train part), then
  one-hot with unknown categories as the all-zero vector. ``StringIndexer``
  with ``handleInvalid="keep"`` puts unseen and null labels in an extra last
  index and ``OneHotEncoder(dropLast=True)`` drops exactly that index, so n
  known levels give n columns.
* numeric columns (hour, minute, is_weekend): null -> mean over the rows
  (compressed rows count by their weight).
* regressor: ``BoostedTrees`` (600 trees, depth 5, step 0.05, rows 0.9 and
  columns 0.9 for each tree, λ 1, squared loss, seed 42), which reads category
  indices and bins of numbers, or ``LeastSquares`` over the one-hot vector.

Training size. Every feature is categorical or an hour, so the number of
distinct feature vectors is bounded by stations x lines x days x hours no
matter how many observations exist. With ``compress=True`` the train part
is first reduced to one row per distinct feature vector carrying the mean
label and the row count as instance weight. For squared loss this is an
exact sufficient statistic: weighted gradients, split gains and leaf values
equal those on the raw rows (rows with equal features never separate). The
one difference is that row sub-sampling draws aggregated rows, not raw
rows. The boosted trees always work on distinct feature vectors.

Reproducibility. Rows and columns of a tree are drawn by hashes and gradients
are summed exactly, so the trees don't depend on the layout of the input or the
width of the cluster. The mean labels are rounded to 9 places, which removes
what is left of the order of summation.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.display import version_stamp
from farebox.operators.baseline import categorical_modes
from farebox.operators.boosting import BoostedTrees, NumericBinner, root_candidates
from farebox.operators.least_squares import LeastSquares

CATEGORICAL = ["station", "line", "day"]
NUMERIC = ["hour", "minute", "is_weekend"]
FEATURES = CATEGORICAL + NUMERIC
LABEL = "label"
WEIGHT = "weight"

# Fixed values of the reference model (trees, depth, rate, sampling, lambda, seed).
GBT_PARAMS = dict(maxIter=600, maxDepth=5, stepSize=0.05, subsamplingRate=0.9,
                  featureSubsetStrategy="0.9", l2=1.0, seed=42)
# Fixed value: the rule as the metadata states it.
SERVICE_HOURS_RULE = "Mon–Fri 06:00–01:30; Sat–Sun 08:00–01:30 (next day)."


class _HasFills(Params):
    fills = Param(Params._dummy(), "fills", "JSON object: column -> fill value",
                  typeConverter=TypeConverters.toString)


class CategoricalModeImputerModel(Model, HasInputCols, _HasFills,
                                  DefaultParamsReadable, DefaultParamsWritable):
    """Replaces nulls in the input columns by the fitted most frequent values."""

    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._setDefault(fills="{}")
        if inputCols is not None:
            self._set(inputCols=inputCols)
        if fills is not None:
            self._set(fills=fills)

    def fill_values(self) -> dict:
        return json.loads(self.getOrDefault(self.fills))

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = {k: v for k, v in self.fill_values().items() if v is not None}
        return df.na.fill(fills) if fills else df


class CategoricalModeImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M2: most frequent value per column (ties -> smallest), in one pass."""

    def __init__(self, inputCols=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, df: DataFrame) -> CategoricalModeImputerModel:
        cols = self.getInputCols()
        return CategoricalModeImputerModel(inputCols=cols,
                                           fills=json.dumps(categorical_modes(df, cols)))


class NumericMeanImputerModel(Model, HasInputCols, _HasFills,
                              DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``<column>_num``: the column as double, nulls replaced by the fitted mean."""

    def __init__(self, inputCols=None, fills=None):
        super().__init__()
        self._setDefault(fills="{}")
        if inputCols is not None:
            self._set(inputCols=inputCols)
        if fills is not None:
            self._set(fills=fills)

    def fill_values(self) -> dict:
        return json.loads(self.getOrDefault(self.fills))

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = self.fill_values()
        return df.withColumns({f"{c}_num": F.coalesce(F.col(c).cast("double"), F.lit(fills[c]).cast("double"))
                               for c in self.getInputCols()})


class NumericMeanImputer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Mean per column over the rows; a ``weight`` column, if any, counts a row so often."""

    def __init__(self, inputCols=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)

    def _fit(self, df: DataFrame) -> NumericMeanImputerModel:
        cols = self.getInputCols()
        weight = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1.0)
        row = df.agg(*[(F.sum(F.col(c) * weight) / F.sum(F.when(F.col(c).isNotNull(), weight))).alias(c) for c in cols]).first()
        return NumericMeanImputerModel(inputCols=cols, fills=json.dumps({c: row[c] for c in cols}))


def preprocessing() -> list[Estimator]:
    """Imputing and indexing, which both regressors share: mode imputer, indexer, mean imputer."""
    return [CategoricalModeImputer(inputCols=CATEGORICAL),
            StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_idx" for c in CATEGORICAL], handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            NumericMeanImputer(inputCols=NUMERIC)]


def design_stages() -> list:
    """From indices and numbers to the ``features`` vector."""
    ohe, num = [f"{c}_ohe" for c in CATEGORICAL], [f"{c}_num" for c in NUMERIC]
    return [OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEGORICAL], outputCols=ohe, dropLast=True),
            VectorAssembler(inputCols=ohe + num, outputCol="features")]


def build_pipeline(algo: str = "gbt", max_iter: int | None = None, weighted: bool = False) -> Pipeline:
    modes, index, means = preprocessing()
    if algo == "gbt":
        params = dict(GBT_PARAMS)
        if max_iter is not None:
            params["maxIter"] = max_iter
        indices = [f"{c}_idx" for c in CATEGORICAL]
        reg = BoostedTrees(inputCols=indices + [f"{c}_bin" for c in NUMERIC], categories=indices, labelCol=LABEL, **params)
        stages = [modes, index, means, NumericBinner(inputCols=NUMERIC)]
    elif algo == "linear":
        reg = LeastSquares(featuresCol="features", labelCol=LABEL)
        encoder, assembler = design_stages()
        stages = [modes, index, encoder, means, assembler]
    else:
        raise ValueError(f"unknown algo {algo!r}")
    if weighted:
        reg.setWeightCol(WEIGHT)
    return Pipeline(stages=stages + [reg])


def training_frame(train: DataFrame, label: str = "riders", compress: bool = True) -> DataFrame:
    """Rows with a label (note e: null targets are not fitted). With
    ``compress``, one row per distinct feature vector: mean label, weight."""
    numeric = [F.col(c).cast("double").alias(c) for c in NUMERIC]
    rows = train.filter(F.col(label).isNotNull()).select(
        *CATEGORICAL, *numeric, F.col(label).alias("_y"))
    if not compress:
        return rows.select(*FEATURES, F.col("_y").cast("double").alias(LABEL))
    # Null categorical cells are filled after fitting the imputer; group on raw
    # values here (null is its own group) so the imputer sees true frequencies
    # through the weights.
    return (rows.groupBy(*FEATURES)
            .agg(F.round(F.sum(F.col("_y").cast("double")) / F.count("_y"), 9).alias(LABEL),
                 F.count("_y").cast("double").alias(WEIGHT)))


class WeightedModeImputer(CategoricalModeImputer):
    """Mode imputer that counts each compressed row by its weight."""

    def _fit(self, df: DataFrame) -> CategoricalModeImputerModel:
        cols = self.getInputCols()
        long = df.select(F.col(WEIGHT).alias("w"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in cols
        ])).alias("kv")).select("w", "kv.col", "kv.val")
        counted = (long.where(F.col("val").isNotNull()).groupBy("col", "val")
                   .agg(F.sum("w").alias("n")))
        best = counted.groupBy("col").agg(
            F.min_by("val", F.struct((-F.col("n")).alias("neg_n"), F.col("val").alias("v")))
            .alias("val")).collect()
        found = {r["col"]: r["val"] for r in best}
        return CategoricalModeImputerModel(
            inputCols=cols, fills=json.dumps({c: found.get(c) for c in cols}))


def fit_model(train: DataFrame, algo: str = "gbt", max_iter: int | None = None,
              compress: bool = True) -> PipelineModel:
    """M7: fit on the train part only."""
    pipeline = build_pipeline(algo, max_iter, weighted=compress)
    return _fit_stages(pipeline.getStages(), train, compress)


def fit_preprocessing(train: DataFrame) -> PipelineModel:
    """M2-M4: imputers and indexer of the train part, without a regressor."""
    return _fit_stages(preprocessing(), train, True)


def fit_design(train: DataFrame) -> PipelineModel:
    """M3-M5: from observations to the ``features`` vector."""
    return _fit_stages(preprocessing() + design_stages(), train, True)


def _fit_stages(stages: list, train: DataFrame, compress: bool) -> PipelineModel:
    if compress:
        stages = [WeightedModeImputer(inputCols=CATEGORICAL), *stages[1:]]
    # Several stages read the frame.
    frame = training_frame(train, compress=compress).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(frame)
    finally:
        frame.unpersist()


def root_split(train: DataFrame) -> list[dict]:
    """M6: what the first tree of an unsampled fit may split its root by. One
    dict for each category ("is it") and each value that an hour, minute or weekend flag is cut below:
    feature, value, gain, mean gain of a row, weights of both sides, whether it is taken."""
    stages = build_pipeline("gbt", weighted=True).getStages()
    prepared = _fit_stages(stages[:-1], train, True)
    frame = training_frame(train)
    booster = stages[-1].setSubsamplingRate(1.0).setFeatureSubsetStrategy("all")
    names = [dict(enumerate(labels)) for labels in prepared.stages[1].labelsArray]
    names += [dict(enumerate(prepared.stages[3].cut_points()[c], 1)) for c in NUMERIC]
    out = []
    for c in root_candidates(booster.frame(prepared.transform(frame))):
        (_, left), (_, right) = c["left"], c["right"]
        out.append(dict(feature=FEATURES[c["feature"]], value=str(names[c["feature"]][c["cut"]]), gain=c["gain"] / (left + right),
                        left=left, right=right, chosen=c["chosen"]))
    return out


def category_levels(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` once for each categorical column: feature, value (nulls filled), and the row's columns."""
    filled = model.stages[0].transform(df)
    levels = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in CATEGORICAL])
    return filled.withColumn("_level", F.explode(levels)).select("_level.*", *[F.col(f"`{c}`") for c in df.columns])


def design_dictionary(design: PipelineModel) -> list[tuple[int, str]]:
    """M5: position and name of each column of the assembled vector."""
    names = [f"{c}={v}" for c, values in zip(CATEGORICAL, design.stages[1].labelsArray) for v in values]
    return list(enumerate(names + NUMERIC))


def design_coordinates(design: PipelineModel, df: DataFrame, keys: list[str]) -> DataFrame:
    """M3 + M5: the assembled vectors in coordinate form: the row's ``keys``, position, column, value; zeros are left out."""
    cells = (design.transform(df).select(*keys, F.posexplode(vector_to_array("features")).alias("position", "value"))
             .where("value != 0"))
    names = F.array(*[F.lit(name) for _, name in design_dictionary(design)])
    return cells.select(*keys, "position", F.element_at(names, F.col("position") + 1).alias("column"), "value")


@dataclass
class PipelineScorer:
    """M8: the fitted pipeline at the ``predict(df) -> df + prediction`` interface."""
    model: PipelineModel

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        cols = df.columns
        scored = self.model.transform(df)
        return scored.select(*cols, F.col("prediction").alias(out))


def model_metadata(spark: SparkSession, metrics: DataFrame, trained_at: Column,
                   algo_text: str) -> DataFrame:
    """K2 + P17: one-row metadata (version, features, algorithm, rule, metrics)."""
    return metrics.select(
        version_stamp(trained_at).alias("model_version"),
        F.array(*[F.lit(c) for c in FEATURES]).alias("features"),
        F.lit(algo_text).alias("algo"),
        F.lit(SERVICE_HOURS_RULE).alias("service_hours_rule"),
        F.struct("r2", "rmse", "mae").alias("metrics"))


META_SCHEMA = ("model_version string, features array<string>, algo string, "
               "service_hours_rule string, metrics struct<r2: double, rmse: double, mae: double>")


#: Folder of the publication marks: empty files named ``<number>-<folder>``.
PUBLISHED = "published"


def save_model(model: PipelineModel, meta: DataFrame, path: str) -> str:
    """K1 + K2: pipeline and metadata in a folder of their own, then published.

    Nothing is overwritten. A reader goes by the marks, and a mark is made last,
    in one step: it finds the model before or the whole new one. Returns the folder.
    """
    name = uuid.uuid4().hex[:12]
    folder = f"{path.rstrip('/')}/{name}"
    model.write().save(f"{folder}/pipeline")
    write_metadata(meta, folder)
    _publish(meta.sparkSession, path, name)
    return folder


def _publish(spark: SparkSession, path: str, name: str) -> None:
    """Makes the mark. Writers that publish at once may share a number; their names then decide which is newer."""
    fs, marks = _folder(spark, path, PUBLISHED)
    number = max((n for n, _ in _marks(spark, path)), default=0) + 1
    fs.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(marks, f"{number:09d}-{name}"))


def _folder(spark: SparkSession, path: str, name: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _marks(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    fs, marks = _folder(spark, path, PUBLISHED)
    if not fs.exists(marks):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(marks)]
    return sorted((int(number), name) for number, _, name in (n.partition("-") for n in names))


def published(spark: SparkSession, path: str) -> list[str]:
    """Folders of the published models, oldest first."""
    return [f"{path.rstrip('/')}/{name}" for _, name in _marks(spark, path)]


def write_metadata(meta: DataFrame, path: str) -> None:
    """K2: the one-row metadata as a JSON file."""
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """K2: the metadata; a missing file or version reads "unknown"."""
    try:
        meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta")
    except AnalysisException:  # no metadata written: version unknown, as the reference
        meta = spark.createDataFrame([(None,)], "model_version string")
    return meta.select(F.coalesce("model_version", F.lit("unknown")).alias("model_version"),
                       *[c for c in meta.columns if c != "model_version"])


def model_versions(spark: SparkSession, path: str) -> DataFrame:
    """K2: metadata of all published models with ``position``, from 1, oldest first."""
    out = None
    for position, folder in enumerate(published(spark, path), 1):
        own = spark.read.schema(META_SCHEMA).json(f"{folder}/meta").select(F.lit(position).alias("position"), "*")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], f"position int, {META_SCHEMA}")


def load_model(spark: SparkSession, path: str, version: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """K1 + K2: the newest published pipeline, or the newest of a version, and
    its metadata. A folder without publication marks is read as one model."""
    folders = published(spark, path)
    if version is not None:
        folders = [f for f in folders if read_metadata(spark, f).first()["model_version"] == version]
        if not folders:
            raise LookupError(f"no published model has version {version!r}")
    folder = folders[-1] if folders else path
    return PipelineModel.load(f"{folder}/pipeline"), read_metadata(spark, folder)
