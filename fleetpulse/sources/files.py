"""File sources and sinks, and conversion to the searchable tables' types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.config import METRICS_TABLE_COLUMNS
from fleetpulse.functions.parsing import no_nan
from fleetpulse.schemas import FEATURE_WINDOW, RAW_WIRE

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def typed_events(df: DataFrame) -> DataFrame:
    """Wire events with their times parsed and not-a-number readings set to null."""
    times = {
        c: F.try_to_timestamp(c)
        for c in ("event_time", "gt_failure_start_ts")
        if c in df.columns
    }
    readings = {
        f.name: no_nan(f.name) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(times | readings)


def read_raw_history(spark: SparkSession, path: str) -> DataFrame:
    """Raw events from JSON lines. Nothing sorts them: order is set where it matters."""
    return typed_events(spark.read.schema(RAW_WIRE).json(path))


def read_feature_windows(spark: SparkSession, path: str) -> DataFrame:
    """Feature windows from JSON lines; blank lines are skipped."""
    return (
        spark.read.schema(FEATURE_WINDOW).json(path).where(F.col("machine_id").isNotNull())
    )


#: Rows of a compressed file, which one task reads as a whole.
FILE_ROWS = 500_000


def write_jsonl(
    df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None
) -> None:
    """JSON lines with ISO timestamps in UTC. ``append`` adds to what is there. ``compression``
    (such as ``gzip``) shortens the files, in which every line repeats all names."""
    writer = df.write.mode(mode).option("timestampFormat", ISO_FORMAT)
    if compression:
        writer = writer.option("compression", compression).option("maxRecordsPerFile", FILE_ROWS)
    writer.json(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the declared columns that are present to their types; others pass unchanged."""
    declared = {f.name: f.dataType for f in schema.fields}
    return df.select(
        *[
            F.col(f"`{c}`").cast(declared[c]).alias(c) if c in declared else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_metrics_csv(spark: SparkSession, path: str, match: str = "name") -> DataFrame:
    """Server metrics as text columns from CSV with a header.

    ``name`` selects the required columns and fails when one is missing. ``position``
    accepts other names when the number of columns is right, and fails otherwise.
    """
    raw = spark.read.option("header", True).csv(path)
    if match == "position":
        if len(raw.columns) != len(METRICS_TABLE_COLUMNS):
            raise ValueError(
                f"Expected {len(METRICS_TABLE_COLUMNS)} columns, found {len(raw.columns)}."
            )
        return raw.toDF(*METRICS_TABLE_COLUMNS)
    if match != "name":
        raise ValueError(f"Unknown match {match!r}: use 'name' or 'position'.")
    missing = [c for c in METRICS_TABLE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return raw.select(*METRICS_TABLE_COLUMNS)
