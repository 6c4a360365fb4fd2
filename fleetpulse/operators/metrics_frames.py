"""Minute means and 10-step frames of the server-metrics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.config import METRIC_COLUMNS
from fleetpulse.functions.parsing import bucket_start
from fleetpulse.operators.ordered import running_sums
from fleetpulse.session import stage


def load_profile(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows read, rows kept, machines kept."""
    read = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return clean.agg(
        F.count(F.lit(1)).alias("rows_kept"), F.count_distinct("machine").alias("machines")
    ).select(read.alias("rows_loaded"), "rows_kept", "machines")


def machine_spans(clean: DataFrame) -> DataFrame:
    """First and last time, span in seconds, and distinct minutes with data per machine."""
    per_minute = clean.groupBy("machine", bucket_start("timestamp", 60).alias("minute")).agg(
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    return (
        per_minute.groupBy("machine")
        .agg(
            F.min("lo").alias("first_log"),
            F.max("hi").alias("last_log"),
            F.count(F.lit(1)).alias("minutes"),
        )
        .withColumn("span_seconds", F.unix_seconds("last_log") - F.unix_seconds("first_log"))
    )


def _whole_days(first: str, last: str) -> Column:
    return F.floor((F.unix_micros(last) - F.unix_micros(first)) / F.lit(86_400_000_000))


def span_filter(
    df: DataFrame, max_days: int = 2, first: str = "timestamp", last: str = "timestamp"
) -> DataFrame:
    """Keep machines whose first-to-last span has at most ``max_days`` whole days."""
    short = (
        df.groupBy("machine")
        .agg(F.min(first).alias("lo"), F.max(last).alias("hi"))
        .where(_whole_days("lo", "hi") <= max_days)
        .select("machine")
    )
    return df.join(short, "machine", "left_semi")


def minute_means(clean: DataFrame, cols: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Mean of every metric per machine and minute; minutes without data do not appear.

    Also keeps the first and last time seen in each minute.
    """
    return (
        clean.groupBy("machine", bucket_start("timestamp", 60).alias("minute"))
        .agg(
            *[F.avg(c).alias(c) for c in cols],
            F.min("timestamp").alias("first_log"),
            F.max("timestamp").alias("last_log"),
        )
        .dropna("any", subset=list(cols))
    )


def scaled_minutes(
    minutes: DataFrame, steps: int = 10, cols: Sequence[str] = METRIC_COLUMNS
) -> DataFrame:
    """Min-max scale each machine over its own minutes; keep machines with more than ``steps``.

    Reduced per machine and joined back, so the bounds combine map-side.
    """
    bounds = (
        minutes.groupBy("machine")
        .agg(
            F.count(F.lit(1)).alias("_minutes"),
            *[F.min(c).alias(f"_lo_{c}") for c in cols],
            *[F.max(c).alias(f"_hi_{c}") for c in cols],
        )
        .where(F.col("_minutes") > steps)
    )

    def scaled(c: str):
        width = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        scale = F.when(width == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), width))
        return (F.col(c) * scale + (-F.col(f"_lo_{c}") * scale)).alias(c)

    return minutes.join(bounds, "machine").select(
        "machine", "minute", "_minutes", *[scaled(c) for c in cols]
    )


def metric_sequences(
    clean: DataFrame, steps: int = 10, max_days: int = 2, cols: Sequence[str] = METRIC_COLUMNS
) -> DataFrame:
    """Scaled ``steps``-minute frames per machine, all but the last full one.

    The cleaned rows are read once: spans and bounds come from the written minutes.
    The span filter bounds a machine to under ``max_days + 1`` days, hence at most
    1,440 x (max_days + 1) minutes, so a window over the whole machine stays small.
    """
    minutes = stage(minute_means(clean, cols), "minutes")
    short = span_filter(minutes, max_days, "first_log", "last_log")
    scaled = scaled_minutes(short, steps, cols)
    in_time = W.partitionBy("machine").orderBy("minute")
    frame = in_time.rowsBetween(-(steps - 1), 0)
    return (
        scaled.select(
            "machine",
            "_minutes",
            F.row_number().over(in_time).alias("_n"),
            F.first("minute").over(frame).alias("start"),
            F.col("minute").alias("end"),
            F.collect_list(F.array(*cols)).over(frame).alias("features"),
        )
        .where((F.col("_n") >= steps) & (F.col("_n") < F.col("_minutes")))
        .withColumn("_index", F.col("_n") - F.lit(steps))
        .select("machine", "start", "end", "_index", "features")
    )


def positional_split(frames: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Add ``position`` (0-based, by machine then time) and ``split``: the last
    ``ceil(test_share * n)`` rows are the test part.

    Positions come from per-machine counts; the rows themselves are not sorted.
    """
    counts = frames.groupBy("machine").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(stage(counts, "frame-counts"), [], ["machine"], ["n"]).select(
        "machine",
        (F.col("cum_n") - F.col("n")).alias("_offset"),
        F.col("total_n").alias("_total"),
    )
    test_rows = F.ceil(F.col("_total") * F.lit(float(test_share)))
    return (
        frames.join(placed, "machine")
        .withColumn("position", F.col("_offset") + F.col("_index"))
        .withColumn(
            "split",
            F.when(F.col("position") < F.col("_total") - test_rows, "train").otherwise("test"),
        )
        .drop("_offset", "_total", "_index")
    )
