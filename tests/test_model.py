"""Model pipeline properties: unknown -> zero vector, save/load equality,
compressed training equals raw-row training for squared loss."""

import math

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from farebox.operators import model as ml

ROWS = [("A", "1", "monday", 6.0, 0, 0, 10.0), ("A", "1", "monday", 6.0, 0, 0, 14.0),
        ("B", "2", "sunday", 9.0, 0, 1, 30.0), ("B", "2", "sunday", 10.0, 0, 1, 31.0),
        ("C", None, "friday", 22.0, 0, 0, 5.0), ("A", "2", None, 7.0, 0, 0, 12.0),
        ("C", "1", "friday", 23.0, 0, 0, 4.0), ("B", "1", "sunday", 12.0, 0, 1, 25.0)] * 5
SCHEMA = ("station string, line string, day string, hour double, minute int, is_weekend int, "
          "riders double")


@pytest.mark.parametrize("compress", [True, False])
def test_same_trees_for_any_layout(spark, compress):
    rows = [(f"S{i % 17}", str(i % 3), ["monday", "sunday", None][i % 3], float(i % 24), 0, i % 2, (i * 37 % 101) / 7)
            for i in range(900)]
    train = spark.createDataFrame(rows, SCHEMA)
    probe = train.select("station", "line", "day", "hour", "minute", "is_weekend").distinct()
    found = []
    for n in (1, 3, 8):
        model = ml.fit_model(train.orderBy(F.rand(n)).repartition(n), algo="gbt", max_iter=4, compress=compress)
        found.append(sorted(map(str, ml.PipelineScorer(model).predict(probe).collect())))
    assert found[0] == found[1] == found[2]


def test_numeric_means_count_compressed_rows_by_weight(spark):
    rows = [("A", "1", "monday", 6.0, 0, 0, 1.0)] * 9 + [("A", "1", "monday", 16.0, 0, 1, 1.0)]
    for compress in (True, False):
        fills = ml.fit_model(spark.createDataFrame(rows, SCHEMA), algo="linear", compress=compress).stages[3].fill_values()
        assert fills == {"hour": 7.0, "minute": 0.0, "is_weekend": 0.1}


def test_unknown_category_is_zero_vector(spark):
    train = spark.createDataFrame(ROWS, SCHEMA)
    model = ml.fit_model(train, algo="linear")
    req = spark.createDataFrame([("ZZZ", "9", "someday", 6.0, 0, 0)],
                                "station string, line string, day string, hour double, "
                                "minute int, is_weekend int")
    out = model.transform(req).select("station_ohe", "line_ohe", "day_ohe").first()
    assert all(v.numNonzeros() == 0 for v in out)
    n_known = train.select("station").distinct().count()
    assert out["station_ohe"].size == n_known


def test_null_categories_take_mode(spark):
    train = spark.createDataFrame(ROWS, SCHEMA)
    model = ml.fit_model(train, algo="linear")
    fills = model.stages[0].fill_values()
    # station: A and B tie (15 rows each) -> smallest; line "1" (20); day "sunday" (15)
    assert fills == {"station": "A", "line": "1", "day": "sunday"}


def test_save_load_same_predictions(spark, tmp_path):
    train = spark.createDataFrame(ROWS, SCHEMA)
    model = ml.fit_model(train, algo="gbt", max_iter=5)
    meta = spark.createDataFrame([("v1", None)], "model_version string, algo string")
    ml.save_model(model, meta, str(tmp_path / "m"))
    loaded, loaded_meta = ml.load_model(spark, str(tmp_path / "m"))
    a = [r[0] for r in ml.PipelineScorer(model).predict(train).select("prediction").collect()]
    b = [r[0] for r in ml.PipelineScorer(loaded).predict(train).select("prediction").collect()]
    assert a == b
    assert loaded_meta.first()["model_version"] == "v1"


def test_compressed_training_equals_raw_rows(spark):
    """Weighted (mean label, count) rows give the same trees as raw rows when
    sampling is off: the documented exactness of ``compress=True``."""
    train = spark.createDataFrame(ROWS, SCHEMA)
    preds = []
    for compress in (False, True):
        pipe = ml.build_pipeline("gbt", max_iter=4, weighted=compress)
        stages = pipe.getStages()
        gbt: GBTRegressor = stages[-1]
        gbt.setSubsamplingRate(1.0).setFeatureSubsetStrategy("all")
        if compress:
            stages[0] = ml.WeightedModeImputer(inputCols=ml.CATEGORICAL)
        from pyspark.ml import Pipeline
        fitted = Pipeline(stages=stages).fit(ml.training_frame(train.withColumn(
            "riders", F.col("riders").cast("decimal(18,2)")), compress=compress))
        preds.append([r[0] for r in fitted.transform(train).orderBy(
            "station", "line", "day", "hour", "riders").select("prediction").collect()])
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(*preds))


def test_missing_metadata_reads_unknown_version(spark, tmp_path):
    train = spark.createDataFrame(ROWS, SCHEMA)
    model = ml.fit_model(train, algo="linear")
    model.write().overwrite().save(str(tmp_path / "m" / "pipeline"))
    _, meta = ml.load_model(spark, str(tmp_path / "m"))
    assert meta.first()["model_version"] == "unknown"


def test_compressed_linear_equals_raw_rows(spark):
    train = spark.createDataFrame(ROWS, SCHEMA).withColumn(
        "riders", F.col("riders").cast("decimal(18,2)"))
    raw = ml.fit_model(train, algo="linear", compress=False).stages[-1]
    packed = ml.fit_model(train, algo="linear", compress=True).stages[-1]
    assert math.isclose(raw.intercept, packed.intercept, rel_tol=1e-7, abs_tol=1e-7)
    assert all(math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)
               for a, b in zip(raw.coefficients, packed.coefficients))


def test_readers_never_see_half_a_model(spark, tmp_path, monkeypatch):
    """Between the writes of a second model, and if they fail, the first one is loaded."""
    train = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "models")

    def meta(version):
        return spark.createDataFrame([(version, None)], "model_version string, algo string")

    ml.save_model(ml.fit_model(train, algo="linear"), meta("v1"), path)
    seen = []
    write = ml.write_metadata

    def watched(frame, folder):
        seen.append(ml.load_model(spark, path)[1].first()["model_version"])       # the pipeline lies there, not yet published
        write(frame, folder)
        seen.append(ml.load_model(spark, path)[1].first()["model_version"])
        if len(seen) > 2:
            raise OSError("writer lost")

    monkeypatch.setattr(ml, "write_metadata", watched)
    second = ml.save_model(ml.fit_model(train.where("line = '1'"), algo="linear"), meta("v2"), path)
    assert seen == ["v1", "v1"] and ml.load_model(spark, path)[1].first()["model_version"] == "v2"
    with pytest.raises(OSError):
        ml.save_model(ml.fit_model(train, algo="linear"), meta("v3"), path)
    assert ml.published(spark, path)[-1] == second and seen[2:] == ["v2", "v2"]
    old, _ = ml.load_model(spark, path, "v1")
    assert len(old.stages[1].labelsArray[1]) == 2 and len(ml.load_model(spark, path)[0].stages[1].labelsArray[1]) == 1
    assert [r["model_version"] for r in ml.model_versions(spark, path).orderBy("position").collect()] == ["v1", "v2"]
    with pytest.raises(LookupError):
        ml.load_model(spark, path, "v9")
