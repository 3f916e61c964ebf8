"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (observations are made from
``events``) so its work grows with them. Column names and types match the
SQL twins in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions import display as disp
from farebox.functions.display import version_stamp
from farebox.functions.hours import service_open
from farebox.operators import context as ctx
from farebox.operators import geo
from farebox.operators import model as ml
from farebox.operators import service_hours as sh
from farebox.operators.clean import clean_observations
from farebox.operators.evaluate import regression_metrics
from farebox.operators.options import options_listing, options_long
from farebox.operators.profile import (combinations, congestion_levels, open_hours_profile,
                                       profile_24h, typical_line)
from farebox.operators.score import normalised_records, parse_records, score, unknown_categories, validate
from farebox.operators.split import bucket_split
from farebox.plans.prepared import TRAINED_AT, baseline, prepare
from farebox.session import materialize, remove_at_exit, scratch_path
from farebox.sources.dimensions import VENUES, venues
from farebox.sources.observations import (observation_standin, raw_observations,
                                          read_observations_csv)
from farebox.sources.payloads import clock_text_standin, landed_events, landed_weather
from farebox.sources.requests import requests_for
from farebox.streaming import scoring as stream_scoring

VENUE_IDS = [venue_id for venue_id, _name, _capacity in VENUES]

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, column: str = "riders") -> DataFrame:
    """A derived column to 6 places ("+ 0.0" turns a rounded -0.0 into 0.0)."""
    return df.withColumn(column, F.round(column, 6) + F.lit(0.0))


def present(df: DataFrame) -> DataFrame:
    """Output presentation shared with the SQL twins: dates as ISO
    ``yyyy-MM-dd`` text."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "date":
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _profile(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The baseline's 24-hour profile and its (station, line, day) combinations."""
    model = baseline(prepare(spark, sf_dir))
    return rounded(profile_24h(model, model.combinations())), model.combinations()


def hourly_profile_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 with M10: 24-hour profile of every station/line/day seen in the
    train part, closed hours exactly 0 riders (the flagship query)."""
    return _profile(spark, sf_dir)[0]


def open_hours_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 with M10: each combination's open plotting hours with predictions."""
    model = baseline(prepare(spark, sf_dir))
    return rounded(open_hours_profile(model, model.combinations()))


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned observations read once, without a stored copy."""
    return clean_observations(raw_observations(spark, sf_dir))


def clean_observations_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, normalised observations without null hours."""
    return _cleaned(spark, sf_dir)


def service_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + F4: observations kept by the train-policy service-hours mask."""
    return sh.service_filter(_cleaned(spark, sf_dir))


def closed_hours_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """where no observation is open (an input of closed hours only), the
    mask falls back to hours 0..23."""
    obs = _cleaned(spark, sf_dir)
    return sh.service_filter(obs.filter(~sh.open_column(obs)))


def service_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: rows before and after the mask."""
    return sh.mask_counts(_cleaned(spark, sf_dir))


def open_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: distinct hours among kept rows."""
    return sh.open_hours(service_filtered(spark, sf_dir))


def service_hours_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open hours of every day label in the data, both policies."""
    return sh.service_hours_by_day(_cleaned(spark, sf_dir))


def minute_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8 + F2 + F3: both policies at every event's own minute: at 01:31 the train rule closes, the serve rule doesn't."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lower(F.date_format("ts", "EEEE")).alias("day"), "ts")
    hour, minute = F.hour("ts"), F.minute("ts")
    return events.select("event_id", "day", hour.alias("hour"), minute.alias("minute"),
                         service_open("day", hour, minute, "train").alias("open_train"),
                         service_open("day", hour, minute, "serve").alias("open_serve"))


def empty_input_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """with no hour in range nothing is left after the fallback, and the run is refused; with rows left it isn't."""
    obs = _cleaned(spark, sf_dir)
    rows = []
    for name, part in (("out of range", obs.withColumn("hour", F.col("hour") + 100)), ("all", obs)):
        kept = sh.service_filter(part)
        try:
            sh.require_rows(kept)
            refused = False
        except RuntimeError:
            refused = True
        rows.append((name, refused))
    return spark.createDataFrame(rows, "input string, refused boolean")


def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 (exact): every kept row with its test flag."""
    return prepare(spark, sf_dir).split.select("obs_id", "is_test")


def split_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 (hash bucket): every kept row with its test flag."""
    return bucket_split(service_filtered(spark, sf_dir)).select("obs_id", "is_test")


def _holdout(prep, scorer) -> DataFrame:
    """Split sizes and hold-out metrics of ``scorer`` (anything with ``predict``)."""
    metrics = regression_metrics(scorer.predict(prep.test))
    n_train, n_test = prep.sizes
    return metrics.select(F.lit(n_train).cast("bigint").alias("n_train"),
                          F.lit(n_test).cast("bigint").alias("n_test"),
                          F.col("n").alias("n_scored"), "r2", "rmse", "mae")


def baseline_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + A4 + K4: fit on the train part, R²/RMSE/MAE on the test part."""
    prep = prepare(spark, sf_dir)
    return _holdout(prep, baseline(prep))


def typical_line_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3 + J4: typical line of every station in the train part."""
    return typical_line(prepare(spark, sf_dir).train)


def options_long_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 + A2 + U2 (long form): hours and distinct days, stations, lines."""
    return options_long(spark, raw_observations(spark, sf_dir))


def options_listing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of sorted option arrays."""
    return options_listing(spark, raw_observations(spark, sf_dir))


def _observations_csv(spark: SparkSession, sf_dir: str, station: Column | None = None) -> str:
    """The raw observations as CSV text with the columns Station, Line, Day,
    Hour, Riders only (padding and tabs kept); returns the folder."""
    path = scratch_path(spark, "observations-csv")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = observation_standin(spark, events)
    if station is not None:
        rows = rows.withColumn("Station", station)
    rows = rows.select("Station", "Line", "Day", "Hour", "Riders")
    (rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    remove_at_exit(spark, path)
    return path


def csv_clean_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations read from CSV as all-text columns, then cleaned. The
    file has no row id and no date; the id made from the text is left out."""
    return clean_observations(read_observations_csv(spark, _observations_csv(spark, sf_dir))).drop("obs_id", "service_date")


def csv_quoted_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third station holds line breaks, quotes and commas inside quotes."""
    odd = F.concat("Station", F.lit('\n\n"upper", level, '), "Day", F.lit('\n",'))
    station = F.when(F.col("obs_id") % 3 == 0, odd).otherwise(F.col("Station"))
    return clean_observations(read_observations_csv(spark, _observations_csv(spark, sf_dir, station))).drop("obs_id", "service_date")


def csv_options_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + G4: the options listing read straight from the CSV
    (``Day``/``Station``/``Line`` headers in any case)."""
    return options_long(spark, read_observations_csv(spark, _observations_csv(spark, sf_dir)))


def _model_version():
    return version_stamp(F.lit(TRAINED_AT).cast("timestamp"))


def _validated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(parse_records(requests_for(spark, sf_dir)))


def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + F10 + M9 + K3 with M10: every valid record scored in one pass,
    closed hours exactly 0, stamped with the model version."""
    model = baseline(prepare(spark, sf_dir))
    valid = _validated_requests(spark, sf_dir).filter(F.col("reason").isNull())
    return rounded(score(valid, model, _model_version()))


def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bodies that do not parse and records that fail validation."""
    return (_validated_requests(spark, sf_dir).filter(F.col("reason").isNotNull())
            .select("request_id", "pos", "reason"))


def rejected_records_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as F10, also refusing hours outside 0..23."""
    return (validate(parse_records(requests_for(spark, sf_dir)), strict=True)
            .filter(F.col("reason").isNotNull()).select("request_id", "pos", "reason"))


def unknown_request_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12 + J8: request values outside the training vocabulary."""
    model = baseline(prepare(spark, sf_dir))
    valid = _validated_requests(spark, sf_dir).filter(F.col("reason").isNull())
    return unknown_categories(valid, model.vocabulary())


def weather_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + F8: temperature and condition from successful weather responses."""
    return ctx.weather_readings(landed_weather(spark, sf_dir))


def failed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: non-200 responses of both feeds, for reporting."""
    w = ctx.failed(landed_weather(spark, sf_dir)).withColumn("feed", F.lit("weather"))
    e = ctx.failed(landed_events(spark, sf_dir)).withColumn("feed", F.lit("events"))
    return w.unionByName(e)


def event_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + P10 + P18: flattened events with first venue and message line."""
    return ctx.event_listings(landed_events(spark, sf_dir))


def daily_event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + L2 + P12: first 100 chosen-venue events inside each day's window."""
    return ctx.daily_listing(ctx.event_listings(landed_events(spark, sf_dir)), venues(spark))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 + P12: request window and venue id list of every day fetched."""
    landed = landed_events(spark, sf_dir)
    days = landed.select(F.col("fetched_at").cast("date").alias("event_date"))
    return ctx.event_windows(days, ctx.event_listings(landed), venues(spark), VENUE_IDS)


def fused_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + J7: kept observations with the weather in force at their hour and
    the day's chosen-venue event count and capacity."""
    kept = prepare(spark, sf_dir).kept
    return ctx.fuse_context(kept, ctx.weather_readings(landed_weather(spark, sf_dir)),
                            ctx.event_listings(landed_events(spark, sf_dir)), venues(spark))


def station_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + F7 + P14 + P15 + P16 + P19: map stations with their 24-hour
    predictions and display texts."""
    profile, combos = _profile(spark, sf_dir)
    return geo.station_predictions(spark, profile, combos)


def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19 + P20: per observed line, counts and mean riders with its map path."""
    return rounded(geo.line_summary(spark, service_filtered(spark, sf_dir)), "mean_riders")


def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 + P21 + P22: clock text parsed to hour/minute, minute of day and
    its cyclical encoding; weekday and hour of the event timestamp."""
    src = clock_text_standin(spark.read.parquet(f"{sf_dir}/events.parquet"))
    hour, minute = disp.parse_clock("clock_text")
    parsed = src.select("event_id", "ts", "clock_text", hour.alias("hour"), minute.alias("minute"))
    mod = disp.minute_of_day("hour", "minute")
    return parsed.select(
        "event_id", "clock_text", "hour", "minute", mod.alias("minute_of_day"),
        # "+ 0.0" turns a rounded -0.0 into 0.0 (engines differ on its sign)
        (F.round(disp.tod_sin(mod), 6) + F.lit(0.0)).alias("tod_sin"),
        (F.round(disp.tod_cos(mod), 6) + F.lit(0.0)).alias("tod_cos"),
        disp.weekday_name("ts").alias("weekday"), F.hour("ts").alias("ts_hour"))


def congestion_levels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network-wide tertile levels of the 24-hour profile."""
    return congestion_levels(materialize(spark, hourly_profile_24h(spark, sf_dir), "profile"))


def category_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + M3: each feature's sorted training categories with their index, as
    fitted by the model's preprocessing."""
    index = ml.fit_preprocessing(prepare(spark, sf_dir).train).stages[1]
    rows = [(feature, i, value) for feature, values in zip(ml.CATEGORICAL, index.labelsArray) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, position int, value string")


def numeric_fill_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + M4: the means that the fitted preprocessing puts for missing numbers."""
    fills = ml.fit_preprocessing(prepare(spark, sf_dir).train).stages[2].fill_values()
    return rounded(spark.createDataFrame(list(fills.items()), "feature string, mean double"), "mean")


def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 + M5: the design matrix in coordinate form, of all kept observations
    (nulls filled) and all valid requests (unknown categories have no column)."""
    prep = prepare(spark, sf_dir)
    design = ml.fit_design(prep.train)
    observations = prep.kept.select(F.lit("observation").alias("origin"), F.col("obs_id").alias("id"), F.lit(0).alias("pos"),
                                    *ml.CATEGORICAL, "hour", "minute", "is_weekend")
    valid = _validated_requests(spark, sf_dir).filter(F.col("reason").isNull())
    requests = normalised_records(valid).select(F.lit("request").alias("origin"), F.col("request_id").alias("id"), "pos",
                                                *ml.CATEGORICAL, "hour", "minute", "is_weekend")
    return ml.design_coordinates(design, observations.unionByName(requests), ["origin", "id", "pos"])


def linear_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted line's residuals add up to 0 in every category, and
    so do they weighted by each number: per column, rows and mean fitted riders (as the labels' own mean)."""
    train = prepare(spark, sf_dir).train.where("riders is not null")
    model = ml.fit_model(train, algo="linear")
    fitted = ml.PipelineScorer(model).predict(train)
    levels = (ml.category_levels(model, fitted).groupBy("feature", "value")
              .agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_fitted")))
    numbers = fitted.select("prediction", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in ml.NUMERIC])).alias("f")).groupBy(
        "f.feature").agg(F.lit("product").alias("value"), F.count("*").alias("n"), F.avg(F.col("f.x") * F.col("prediction")).alias("mean_fitted"))
    return rounded(levels.unionByName(numbers), "mean_fitted")


def gbt_root_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: every split that the first tree's root may take, without sampling: gain per row and both sides' rows."""
    rows = [(c["feature"], c["value"], round(c["gain"], 4) + 0.0, int(c["left"]), int(c["right"]), c["chosen"])
            for c in ml.root_split(prepare(spark, sf_dir).train)]
    return spark.createDataFrame(rows, "feature string, value string, gain double, n_left long, n_right long, chosen boolean")


def model_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + P17 + K4: the fitted model's metadata written as JSON to the shared
    folder and read back; a missing version reads as "unknown"."""
    prep = prepare(spark, sf_dir)
    metrics = regression_metrics(baseline(prep).predict(prep.test))
    meta = ml.model_metadata(spark, metrics, F.lit(TRAINED_AT).cast("timestamp"),
                             "cell mean + categorical mode fill (baseline)")
    path = scratch_path(spark, "model-card")
    ml.write_metadata(meta, path)
    remove_at_exit(spark, path)
    return ml.read_metadata(spark, path).select("model_version", "features", "algo", "service_hours_rule", "metrics.*")


def published_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K2: two models published one after the other (all lines, then line 1
    only), each loaded by its version: its metadata and how many categories its pipeline knows."""
    train = prepare(spark, sf_dir).train
    path = scratch_path(spark, "published-models")
    for hours, part in enumerate((train, train.where("line = '1'"))):
        trained_at = F.lit(TRAINED_AT).cast("timestamp") + F.expr(f"interval {hours} hours")
        stats = part.agg(F.lit(0.0).alias("r2"), F.count("riders").cast("double").alias("rmse"), F.lit(0.0).alias("mae"))
        ml.save_model(ml.fit_preprocessing(part), ml.model_metadata(spark, stats, trained_at, f"part {hours}"), path)
    remove_at_exit(spark, path)
    rows = []
    for version in ml.model_versions(spark, path).orderBy("position").collect():
        model, meta = ml.load_model(spark, path, version["model_version"])
        known = [len(labels) for labels in model.stages[1].labelsArray]
        rows.append((version["position"], version["model_version"], meta.first()["algo"], int(version["metrics"]["rmse"]), *known))
    return spark.createDataFrame(rows, "position int, model_version string, algo string, n_rows long, stations int, lines int, days int")


def _fit(prep, algo: str = "gbt"):
    return ml.fit_model(prep.train, algo=algo)


def gbt_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2-M7 + A4: boosted trees fitted on the train part, scored on the test part."""
    prep = prepare(spark, sf_dir)
    return _holdout(prep, ml.PipelineScorer(_fit(prep, "gbt")))


def linear_holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + A4: linear regression on the same features."""
    prep = prepare(spark, sf_dir)
    return _holdout(prep, ml.PipelineScorer(_fit(prep, "linear")))


def gbt_scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 + K2 + M8 + M9: fit, save model and metadata to the shared folder,
    load both back, and score every valid request (closed hours 0)."""
    prep = prepare(spark, sf_dir)
    model = _fit(prep, "gbt")
    metrics = regression_metrics(ml.PipelineScorer(model).predict(prep.test))
    meta = ml.model_metadata(spark, metrics, F.lit(TRAINED_AT).cast("timestamp"),
                             f"boosted trees ({ml.GBT_PARAMS['maxIter']}) + one-hot(station/line/day)")
    path = scratch_path(spark, "gbt-model")
    ml.save_model(model, meta, path)
    remove_at_exit(spark, path)
    loaded, loaded_meta = ml.load_model(spark, path)
    version = loaded_meta.first()["model_version"]
    # Scoring reads the requests twice (distinct vectors, then all rows): they are parsed and judged once, then stored.
    judged = materialize(spark, _validated_requests(spark, sf_dir), "judged-records")
    return score(judged.filter(F.col("reason").isNull()), ml.PipelineScorer(loaded), version)


def gbt_profile_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 with the boosted-tree model."""
    prep = prepare(spark, sf_dir)
    model = _fit(prep, "gbt")
    fills = model.stages[0].fill_values()
    filled = prep.train.na.fill({k: v for k, v in fills.items() if v is not None})
    return profile_24h(ml.PipelineScorer(model), combinations(filled))


def _streamed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Requests as JSON files, scored by a Structured Streaming query."""
    model = baseline(prepare(spark, sf_dir))
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("requests-landing", "requests-scored", "stream-ckpt"))
    stream_scoring.land_requests(requests_for(spark, sf_dir), landing)
    q = stream_scoring.start_scoring_stream(spark, landing, out, checkpoint, model, _model_version())
    q.awaitTermination()
    for path in (landing, out, checkpoint):
        remove_at_exit(spark, path)
    return stream_scoring.read_output(spark, out, kind)


def streamed_scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request files scored as a stream; equals ``scored_requests``."""
    return rounded(_streamed(spark, sf_dir, "scored"))


def streamed_rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + F10: what the stream rejects; equals ``rejected_records``."""
    return _streamed(spark, sf_dir, "rejected")


_QUERIES: dict[str, Query] = {
    "hourly_profile_24h": hourly_profile_24h,
    "open_hours_profile": open_hours_profile_q,
    "clean_observations": clean_observations_q,
    "service_filtered": service_filtered,
    "closed_hours_fallback": closed_hours_fallback,
    "service_mask_counts": service_mask_counts,
    "open_hours": open_hours,
    "service_hours_by_day": service_hours_by_day,
    "minute_service": minute_service,
    "empty_input_refused": empty_input_refused,
    "split_exact": split_exact,
    "split_bucket": split_bucket,
    "baseline_holdout_metrics": baseline_holdout_metrics,
    "typical_line": typical_line_q,
    "options_long": options_long_q,
    "options_listing": options_listing_q,
    "csv_clean_observations": csv_clean_observations,
    "csv_quoted_observations": csv_quoted_observations,
    "csv_options_long": csv_options_long,
    "scored_requests": scored_requests,
    "rejected_records": rejected_records,
    "rejected_records_strict": rejected_records_strict,
    "unknown_request_categories": unknown_request_categories,
    "weather_readings": weather_readings,
    "failed_responses": failed_responses,
    "event_listings": event_listings,
    "daily_event_listing": daily_event_listing,
    "event_windows": event_windows,
    "fused_observations": fused_observations,
    "station_predictions": station_predictions,
    "line_summary": line_summary,
    "time_features": time_features,
    "congestion_levels": congestion_levels_q,
    "model_card": model_card,
    "published_models": published_models,
    "gbt_root_split": gbt_root_split,
    "gbt_holdout_metrics": gbt_holdout_metrics,
    "linear_holdout_metrics": linear_holdout_metrics,
    "linear_normal_equations": linear_normal_equations,
    "gbt_scored_requests": gbt_scored_requests,
    "gbt_profile_24h": gbt_profile_24h,
    "category_vocabulary": category_vocabulary,
    "numeric_fill_means": numeric_fill_means,
    "design_matrix": design_matrix,
    "streamed_scored_requests": streamed_scored_requests,
    "streamed_rejected_records": streamed_rejected_records,
}


def _presented(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(spark, sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES: dict[str, Query] = {name: _presented(fn) for name, fn in _QUERIES.items()}
