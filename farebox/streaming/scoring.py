"""Continuous request scoring: T1.

``POST /predict`` re-aimed as a stream: request files (JSON lines with
``request_id, body``) land in a folder; each micro-batch is parsed,
validated and scored with the same functions as the batch path, so the
stream's output equals the batch result on the same rows. Scoring is
stateless (append only). ``foreachBatch`` sends valid rows and rejections
to two sinks; every epoch writes to its own folder with overwrite, so a
micro-batch replayed after a failure replaces its own output instead of
duplicating it, and the checkpoint in the shared folder lets a restarted
query resume where it stopped.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators.score import parse_records, score, validate

REQUEST_FILE_SCHEMA = "request_id bigint, body string"


def land_requests(requests: DataFrame, path: str) -> None:
    """Write request rows as JSON-lines files (the stream's input)."""
    requests.write.mode("overwrite").json(path)


def start_scoring_stream(spark: SparkSession, landing: str, out: str, checkpoint: str,
                         model, model_version, strict: bool = False,
                         bytes_per_trigger: int = 1 << 30):
    """Start the scoring query with an available-now trigger; returns the
    ``StreamingQuery``. Scored rows go to ``out/scored``, rejections to
    ``out/rejected``, one ``epoch=<id>`` folder per micro-batch."""
    stream = (spark.readStream.schema(REQUEST_FILE_SCHEMA)
              .option("maxBytesPerTrigger", bytes_per_trigger).json(landing))

    def handle(batch: DataFrame, epoch_id: int) -> None:
        checked = validate(parse_records(batch), strict=strict).persist(
            StorageLevel.MEMORY_AND_DISK)
        try:
            valid = checked.filter(F.col("reason").isNull())
            score(valid, model, model_version).write.mode("overwrite").parquet(
                f"{out}/scored/epoch={epoch_id}")
            (checked.filter(F.col("reason").isNotNull()).select("request_id", "pos", "reason")
             .write.mode("overwrite").parquet(f"{out}/rejected/epoch={epoch_id}"))
        finally:
            checked.unpersist()

    return (stream.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_output(spark: SparkSession, out: str, kind: str = "scored") -> DataFrame:
    return spark.read.parquet(f"{out}/{kind}").drop("epoch")
