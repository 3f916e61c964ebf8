"""End-to-end jobs, the empty-mask fallback (F4) and the empty guard."""

import pytest
from pyspark.sql import functions as F

from farebox.operators.clean import clean_observations
from farebox.operators.service_hours import mask_counts, require_rows, service_filter
from farebox.plans.jobs import score_job, train_job
from farebox.session import scratch_path
from farebox.sources.observations import observation_standin, read_observations_csv
from farebox.sources.requests import request_standin


def _obs(spark, rows):
    return spark.createDataFrame(rows, "obs_id long, station string, line string, day string, "
                                       "hour string, riders string, date string")


def test_fallback_when_mask_removes_everything(spark):
    # Only closed hours (02:00-05:00): the mask keeps nothing, the fallback keeps 0..23.
    obs = clean_observations(_obs(spark, [(1, "A", "1", "monday", "3", "5", None),
                                          (2, "A", "1", "monday", "4", "6", None),
                                          (3, "A", "1", "monday", "30", "6", None)]))
    c = mask_counts(obs).first()
    assert (c["n_before"], c["n_open"], c["n_after"], c["fallback_used"]) == (3, 0, 2, True)
    assert sorted(r[0] for r in service_filter(obs).select("obs_id").collect()) == [1, 2]


def test_empty_guard(spark):
    obs = clean_observations(_obs(spark, [(1, "A", "1", "monday", "30", "5", None)]))
    with pytest.raises(RuntimeError):
        require_rows(service_filter(obs))


def test_train_then_score_from_csv(spark, small_dir):
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    csv = scratch_path(spark, "test-csv")
    (observation_standin(spark, events).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(csv))
    out = scratch_path(spark, "test-model")
    res = train_job(spark, read_observations_csv(spark, csv), out, algo="gbt", max_iter=3,
                    trained_at=F.lit("2024-02-01 12:46:00").cast("timestamp"))
    assert res["rows_after_mask"] > 0 and res["n_scored"] > 0
    scored_dir = scratch_path(spark, "test-scored")
    reqs = request_standin(spark, events)
    score_job(spark, out, reqs, scored_dir)
    scored = spark.read.parquet(f"{scored_dir}/scored")
    rejected = spark.read.parquet(f"{scored_dir}/rejected")
    assert scored.filter(F.col("model_version") != "v2024.02.01.1246").count() == 0
    assert scored.count() + rejected.filter("pos >= 0").count() > 0
    closed = scored.filter("hour between 2 and 5")
    assert closed.count() > 0 and closed.filter("riders != 0.0").count() == 0


def test_cli_options_profile_version(spark, small_dir, capsys):
    from farebox.plans.jobs import main
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    csv = scratch_path(spark, "cli-csv")
    observation_standin(spark, events).write.option("header", True).csv(csv)
    out = scratch_path(spark, "cli-model")
    main(["train", "--csv", csv, "--out", out, "--algo", "linear"])
    main(["options", "--csv", csv])
    main(["profile", "--model", out, "--station", "Finch", "--line", "1", "--day", "Monday"])
    main(["version", "--model", out])
    text = capsys.readouterr().out
    assert "'hours': [0, 1, 2" in text and "Finch" in text and text.strip().splitlines()[-1].startswith("v")
