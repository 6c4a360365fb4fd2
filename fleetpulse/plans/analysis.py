"""The exploratory analysis as a set of tables, and the anomaly-detection run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.operators import anomaly, explore
from fleetpulse.operators.cleaning import clean_metrics, explore_metrics, require_rows
from fleetpulse.operators.metrics_frames import metric_sequences, positional_split
from fleetpulse.session import stage


def run_analysis(raw: DataFrame) -> dict[str, DataFrame]:
    """Prepare the metrics table once and describe it: one table per chart."""
    df = require_rows(stage(explore_metrics(raw), "metrics"))
    return {
        "mean_cpu_by_machine": explore.mean_by_machine(df, "cpu_usage"),
        "mean_gpu_by_machine": explore.mean_by_machine(df, "gpu_wrk_util"),
        "cpu_gpu_means": explore.cpu_gpu_means(df),
        "cpu_over_time": explore.metric_over_time(df, "cpu_usage"),
        "gpu_over_time": explore.metric_over_time(df, "gpu_wrk_util"),
        "cpu_histogram": explore.histogram(df, "cpu_usage"),
        "cpu_box": explore.box_stats(df),
        "cpu_violin": explore.violin_stats(df),
        "cpu_density": explore.violin_density(df),
        "correlation": explore.correlation_matrix(df),
        "cpu_vs_gpu": explore.scatter_points(df),
        "cpu_gpu_stack": explore.sum_by(df, "timestamp", ["cpu_usage", "gpu_wrk_util"]),
        "io_by_machine": explore.sum_by(df, "machine", ["read", "write"]),
        "io_over_time": explore.sum_by(df, "timestamp", ["read", "write"]),
    }


@dataclass
class AnomalyRun:
    flagged: DataFrame
    summary: DataFrame
    first: DataFrame
    injected: DataFrame


def run_anomaly_detection(raw: DataFrame, k: int = 16, q: float = 0.99) -> AnomalyRun:
    """Clean, frame, fit on the earlier part, flag the later part, check with injected failures."""
    frames = stage(positional_split(metric_sequences(clean_metrics(raw))), "metric-frames")
    if frames.isEmpty():
        raise ValueError("No sequences were built: too little data per machine.")
    fitted = anomaly.fit_reconstruction(frames.where(F.col("split") == "train"), k)
    errors = stage(fitted.errors(frames).drop("features"), "errors")
    train, test = (errors.where(F.col("split") == name) for name in ("train", "test"))
    flagged = anomaly.flag_anomalies(train, test, q=q)
    injected = fitted.errors(anomaly.inject_scenarios(anomaly.injection_base(frames)))
    return AnomalyRun(
        flagged,
        anomaly.anomaly_summary(train, flagged),
        anomaly.first_flagged(flagged),
        anomaly.detection_rates(injected, anomaly.error_threshold(train, q=q).scalar()),
    )
