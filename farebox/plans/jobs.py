"""End-to-end jobs: training and batch scoring.

    python -m farebox.plans.jobs train --csv <observations.csv> --out <model dir>
                                       [--algo gbt|linear] [--trees 600]
    (all: [--scratch <shared folder>], where spark.checkpoint.dir is unset)
    python -m farebox.plans.jobs score --model <model dir> --requests <json files>
                                       --out <output dir> [--strict] [--bodies]
    python -m farebox.plans.jobs options --csv <observations.csv>
    python -m farebox.plans.jobs profile --model <model dir> --station Finch --line 1
                                         --day monday [--hours all|open]
    python -m farebox.plans.jobs version --model <model dir>

``train`` is the reference's training script as one chain of Spark jobs:
read (all text) -> clean -> drop null hours -> service-hours mask with
fallback -> fail if empty -> exact 80/20 split -> fit on the train part ->
R²/RMSE/MAE on the test part -> save pipeline and metadata. ``score`` loads
the pipeline and its metadata and scores landed request bodies in one pass,
writing predictions and rejections separately; with ``--bodies`` each file is
one body as it was sent. Master and widths are spark-submit's; intermediate
copies go to the scratch folder and are removed when the job ends.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import model as ml
from farebox.operators.clean import clean_observations
from farebox.operators.evaluate import regression_metrics
from farebox.operators.score import parse_records, score, validate
from farebox.operators.service_hours import mask_metrics, require_rows, service_filter
from farebox.operators.split import exact_split
from farebox.session import materialize


def train_job(spark: SparkSession, raw: DataFrame, out_path: str, algo: str = "gbt",
              max_iter: int | None = None, trained_at: Column | None = None,
              compress: bool = True) -> dict:
    """Fit, evaluate and save; returns counts and metrics (a few numbers)."""
    cleaned = clean_observations(raw)
    # The mask counts are observed while the cleaned table is written.
    obs, counts = materialize(spark, cleaned, "train-clean", mask_metrics(cleaned))
    kept = require_rows(service_filter(obs, n_open=counts["n_open"]))
    split = exact_split(kept)
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    model = ml.fit_model(train, algo=algo, max_iter=max_iter, compress=compress)
    metrics = regression_metrics(ml.PipelineScorer(model).predict(test))
    trees = max_iter if max_iter is not None else ml.GBT_PARAMS["maxIter"]
    algo_text = (f"boosted trees ({trees}, depth 5) + one-hot(station/line/day)"
                 if algo == "gbt" else "least squares + one-hot(station/line/day)")
    meta = ml.model_metadata(spark, metrics, trained_at if trained_at is not None
                             else F.current_timestamp(), algo_text)
    ml.save_model(model, meta, out_path)
    m = metrics.first()
    fallback = counts["n_open"] == 0
    return {"rows_before_mask": counts["n_before"],
            "rows_after_mask": counts["n_in_range"] if fallback else counts["n_open"],
            "fallback_used": fallback, "n_scored": m["n"],
            "r2": m["r2"], "rmse": m["rmse"], "mae": m["mae"], "model_path": out_path}


def score_job(spark: SparkSession, model_path: str, requests: DataFrame, out_path: str,
              strict: bool = False) -> None:
    """Score ``request_id, body`` rows; predictions and rejections to two outputs."""
    model, meta = ml.load_model(spark, model_path)
    version = meta.first()["model_version"]
    checked = materialize(spark, validate(parse_records(requests), strict=strict), "score-checked")
    valid = checked.filter(F.col("reason").isNull())
    score(valid, ml.PipelineScorer(model), version).write.mode("overwrite").parquet(
        f"{out_path}/scored")
    (checked.filter(F.col("reason").isNotNull()).select("request_id", "pos", "reason")
     .write.mode("overwrite").parquet(f"{out_path}/rejected"))


def main(argv=None) -> None:
    from farebox.session import job_session
    from farebox.sources.observations import read_observations_csv
    from farebox.sources.requests import read_request_bodies

    p = argparse.ArgumentParser(prog="farebox.plans.jobs")
    p.add_argument("--scratch", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--csv", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--algo", default="gbt", choices=["gbt", "linear"])
    t.add_argument("--trees", type=int, default=None)
    s = sub.add_parser("score")
    s.add_argument("--model", required=True)
    s.add_argument("--requests", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--strict", action="store_true")
    s.add_argument("--bodies", action="store_true")
    o = sub.add_parser("options")
    o.add_argument("--csv", required=True)
    pr = sub.add_parser("profile")
    pr.add_argument("--model", required=True)
    pr.add_argument("--station", required=True)
    pr.add_argument("--line", required=True)
    pr.add_argument("--day", required=True)
    pr.add_argument("--hours", default="all", choices=["all", "open"])
    v = sub.add_parser("version")
    v.add_argument("--model", required=True)
    args = p.parse_args(argv)
    spark = job_session(scratch=args.scratch)
    if args.cmd == "train":
        raw = read_observations_csv(spark, args.csv)
        print(train_job(spark, raw, args.out, algo=args.algo, max_iter=args.trees))
    elif args.cmd == "score":
        reqs = (read_request_bodies(spark, args.requests) if args.bodies
                else spark.read.schema("request_id bigint, body string").json(args.requests))
        score_job(spark, args.model, reqs, args.out, strict=args.strict)
    elif args.cmd == "options":
        from farebox.operators.options import options_listing
        print(options_listing(spark, read_observations_csv(spark, args.csv)).first().asDict())
    elif args.cmd == "profile":
        from farebox.operators.profile import profile_for
        model, _ = ml.load_model(spark, args.model)
        day = args.day.strip().lower()
        profile_for(spark, ml.PipelineScorer(model), args.station.strip(), args.line.strip(),
                    day, args.hours).orderBy("hour").show(24, truncate=False)
    else:
        _, meta = ml.load_model(spark, args.model)
        print(meta.first()["model_version"])


if __name__ == "__main__":
    main()
