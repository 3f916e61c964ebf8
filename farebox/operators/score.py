"""Request parsing, validation and guarded scoring: S7, F10, F11, F12, J8,
M8, M9, K3.

One pass over the request bodies. A body is parsed once, strictly, to a
variant; ``records`` is a lone object or a list, whose elements are judged one
by one on their JSON types. Every record leaves with either a prediction or a
rejection reason; nothing is scored one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.functions.hours import is_weekend, service_open
from farebox.functions.text import norm_day, strip

# A whole number as text, as a lenient integer field takes it.
_WHOLE = r"^\s*[+-]?\d+(\.0+)?\s*$"
_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
TEXT_FIELDS = ("station", "line", "day")


def parse_records(requests: DataFrame) -> DataFrame:
    """request_id, pos, body_ok, is_object, station, line, day, hour_value, and each field's JSON type.

    A body that is not JSON, or whose ``records`` is no object or list, yields
    one row with ``body_ok = false`` and ``pos = -1`` (no record position); an
    empty list yields no rows.
    """
    # The parser stops behind the first value; inside brackets, text behind it is an error or a second element.
    bracketed = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    parsed = requests.select("request_id", bracketed.alias("v"))
    records = F.try_variant_get("v", "$[0].records", "variant")
    kind = F.schema_of_variant(records)
    whole = F.size(F.try_variant_get("v", "$", "array<variant>")) == 1
    listed = (F.when(whole & kind.startswith("ARRAY"), F.try_variant_get("v", "$[0].records", "array<variant>"))
              .when(whole & kind.startswith("OBJECT"), F.array(records)))
    filler = F.array(F.lit(None).cast("variant"))
    exploded = parsed.select("request_id", listed.alias("records")).select(
        "request_id", F.col("records").isNotNull().alias("body_ok"),
        F.posexplode(F.coalesce(F.col("records"), filler)).alias("pos", "r"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("r", f"$.{name}", kind)

    kinds = {c: F.schema_of_variant(field(c, "variant")) for c in (*TEXT_FIELDS, "hour")}
    hour = (F.when((kinds["hour"] == "STRING") & field("hour", "string").rlike(_WHOLE), field("hour", "string").try_cast("double"))
            .when(kinds["hour"].rlike(_NUMBERS), field("hour", "double"))
            .when(kinds["hour"] == "BOOLEAN", field("hour", "boolean").cast("double")))
    return exploded.select(
        "request_id", F.when(F.col("body_ok"), F.col("pos")).otherwise(F.lit(-1)).alias("pos"), "body_ok",
        F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False)).alias("is_object"),
        *[F.when(kinds[c] == "STRING", field(c, "string")).alias(c) for c in TEXT_FIELDS],
        hour.alias("hour_value"), *[F.coalesce(k, F.lit("VOID")).alias(f"{c}_type") for c, k in kinds.items()])


def validate(records: DataFrame, strict: bool = False) -> DataFrame:
    """F10 (F11 with ``strict``): request_id, pos, station, line, day, ``hour``
    (int) and ``reason`` (null when valid)."""
    value = F.col("hour_value")
    hour = F.when((value == F.floor(value)) & (F.abs(value) < 2147483648.0), value.cast("int"))
    reason = F.when(~F.col("body_ok"), F.lit("invalid body")).when(~F.col("is_object"), F.lit("record is not an object"))
    for c in TEXT_FIELDS:
        reason = (reason.when(F.col(f"{c}_type") == "VOID", F.lit(f"missing {c}"))
                  .when(F.col(f"{c}_type") != "STRING", F.lit(f"{c} is not text")))
    reason = (reason.when(F.col("hour_type") == "VOID", F.lit("missing hour"))
              .when(hour.isNull(), F.lit("hour is not an integer")))
    if strict:
        reason = reason.when(~hour.between(0, 23), F.lit("hour out of range"))
    return records.select("request_id", "pos", *TEXT_FIELDS, hour.alias("hour"), reason.alias("reason"))


def normalised_records(valid: DataFrame) -> DataFrame:
    """Echo values: station/line stripped, day lower-cased and stripped."""
    day = norm_day("day")
    return valid.select(
        "request_id", "pos", strip("station").alias("station"), strip("line").alias("line"),
        day.alias("day"), "hour", F.lit(0).alias("minute"), is_weekend(day).alias("is_weekend"))


def score(valid: DataFrame, model, model_version) -> DataFrame:
    """M8 + M9 + K3: one model pass; closed hours (serve policy) are exactly 0.0,
    open hours take the prediction unclipped."""
    rows = normalised_records(valid)
    scored = model.predict(rows)
    is_open = service_open("day", "hour", None, "serve")
    return scored.select(
        "request_id", "pos", "station", "line", "hour", "day",
        F.when(is_open, F.col("prediction").cast("double")).otherwise(F.lit(0.0)).alias("riders"),
        (model_version if isinstance(model_version, Column) else F.lit(model_version))
        .alias("model_version"))


def unknown_categories(valid: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """F12 + J8: categorical values the model never saw (scored as unknown).

    ``vocabulary`` is long form (feature, value). Requests are stacked to the
    same long form and anti-joined once. The planner broadcasts the vocabulary
    if its bytes are under the session's threshold.
    """
    rows = normalised_records(valid)
    long = rows.select("request_id", "pos", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
        for c in ("station", "line", "day")])).alias("kv")).select(
        "request_id", "pos", "kv.feature", "kv.value")
    return long.join(vocabulary, ["feature", "value"], "left_anti")

