"""Tables behind the fleet dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.rules import gauge_band_col

# Band names, mildest first.
BANDS = ["low", "medium", "high", "critical"]


def fleet_latest(predictions: DataFrame, time: str = "window_end") -> DataFrame:
    """The newest prediction of every machine, reduced map-side."""
    rest = [c for c in predictions.columns if c != "machine_id"]
    newest = predictions.groupBy("machine_id").agg(
        F.max_by(F.struct(*rest), time).alias("_row")
    )
    return newest.select("machine_id", "_row.*").select(*predictions.columns)


def fleet_risk(predictions: DataFrame, time: str = "window_end") -> DataFrame:
    """Newest prediction per machine, highest risk first."""
    return fleet_latest(predictions, time).orderBy(F.desc("p_fail_5m"), "machine_id")


def host_timeline(windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each window's headline measures with the model score laid over them, where one exists."""
    scores = predictions.select("machine_id", "window_end", "p_fail_5m")
    return windows.select(
        "machine_id",
        "window_end",
        "cpu_pct_mean",
        "mem_pct_mean",
        "latency_p95_ms_mean",
        "error_count_sum",
    ).join(scores, ["machine_id", "window_end"], "left")


def early_warning(predictions: DataFrame) -> DataFrame:
    """Elevated risk on sufficiently complete data."""
    return predictions.where(
        F.col("risk_band").isin("high", "critical") & F.col("missing_ratio").between(0.0, 0.5)
    )


def gauge(predictions: DataFrame) -> DataFrame:
    """Newest score per machine with its gauge band."""
    return fleet_latest(predictions).select(
        "machine_id", "p_fail_5m", gauge_band_col("p_fail_5m").alias("gauge_band")
    )


def by_failure_type(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("predicted_failure_type").agg(F.count(F.lit(1)).alias("n"))


def machine_band_matrix(predictions: DataFrame) -> DataFrame:
    """Predictions per machine (rows) and risk band (columns)."""
    return predictions.groupBy("machine_id").agg(
        *[F.count_if(F.col("risk_band") == band).alias(band) for band in BANDS]
    )


def run_summary(windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: windows processed and predictions emitted."""
    emitted = predictions.agg(F.count(F.lit(1)).alias("n")).scalar()
    return windows.agg(F.count(F.lit(1)).alias("windows_processed")).withColumn(
        "predictions_emitted", emitted
    )
