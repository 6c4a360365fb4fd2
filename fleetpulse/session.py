"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fleetpulse", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The JVM never compiles methods over 8,000 bytes: wide projections run several times
    # faster outside whole-stage code, where their expressions are split into methods.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fleetpulse-"))
    return spark.sparkContext.getCheckpointDir()


def _run_dir(spark: SparkSession) -> str:
    """All intermediate tables of one application lie under one folder."""
    return f"{shared_dir(spark).rstrip('/')}/fleetpulse/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result reads them any more."""
    jvm, context = spark._jvm, spark.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later branches prune columns from
    Parquet instead of repeating the work, and a lost executor costs no recomputation.

    Nothing reads the shuffles of the write after it, so their files go when it ends.
    """
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_path(spark, label), spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)
