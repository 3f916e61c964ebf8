"""Session construction and shared scratch locations.

Intermediate tables and saved models go under the folder the cluster names
in ``spark.checkpoint.dir`` (a shared file system on a real cluster). Only
when that setting is absent, as in local tests, is a local folder created
and registered.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every farebox job relies on. Shuffle width is a default for
# local runs; on a cluster pass a value sized to the data (about one
# partition per 128-256 MB of shuffle input) and let AQE coalesce.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def job_session(app_name: str = "farebox", scratch: str | None = None) -> SparkSession:
    """The session of a submitted job: master and widths are spark-submit's.

    ``scratch`` is the shared folder for intermediate tables, used where
    ``spark.checkpoint.dir`` is unset.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sc = spark.sparkContext
    if scratch and not sc.getConf().get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch)
    ensure_checkpoint_dir(spark)
    return spark


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "farebox", extra: dict | None = None) -> SparkSession:
    """A local session, for tests and benchmarks."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering a local one only if unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return base
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        # A machine-local folder is invisible to other executors.
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    # Unset in local mode (tests): register a fresh local folder.
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="farebox-ckpt-"))
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: jobs that
    run its Python code in tasks need nothing installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="farebox-py-")) / "farebox.zip"       # Spark's file server hands it out
    target.write_bytes(packed.getvalue())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/farebox/{name}-{uuid.uuid4().hex[:12]}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` (already written) removed when the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def remove_now(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(spark: SparkSession, df, name: str, metrics: list | None = None):
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    the upstream plan) and lets several later jobs scan a compact, already
    computed table instead of repeating the work. With ``metrics`` (aggregate
    columns) the write also observes them and the call returns
    ``(table, metrics_dict)``: no extra pass over the data. The copy is removed
    when the application ends.
    """
    from pyspark.sql import Observation

    path = scratch_path(spark, name)
    observation = None
    if metrics:
        observation = Observation(name)
        df = df.observe(observation, *metrics)
    df.write.mode("overwrite").parquet(path)
    remove_at_exit(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    return (table, observation.get) if observation is not None else table
