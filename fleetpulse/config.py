"""Default parameters and fixed vocabularies of the telemetry domain."""

from __future__ import annotations

from dataclasses import dataclass

# Stream names, shared with producers and consumers.
RAW_TOPIC = "infra.raw.metrics"
FEATURE_TOPIC = "infra.feature.windows"
PREDICTION_TOPIC = "infra.predictions"
DEAD_LETTER_TOPIC = "infra.dlq"

# Model inputs, in the order a trained model expects them.
MODEL_COLUMNS = [
    "cpu_pct_mean",
    "cpu_pct_max",
    "cpu_delta",
    "mem_pct_mean",
    "mem_pct_max",
    "mem_delta",
    "disk_used_pct_mean",
    "disk_io_wait_pct_mean",
    "disk_io_wait_pct_max",
    "request_rate_mean",
    "latency_p95_ms_mean",
    "latency_delta",
    "error_count_sum",
    "error_rate",
    "queue_depth_mean",
    "queue_delta",
    "net_retransmit_pct_mean",
    "throughput_total",
    "heartbeat_drop_ratio",
    "missing_ratio",
]

# Server-metrics table columns.
METRIC_COLUMNS = [
    "cpu_usage",
    "gpu_wrk_util",
    "avg_mem",
    "max_mem",
    "avg_gpu_wrk_mem",
    "max_gpu_wrk_mem",
    "read",
    "write",
    "read_count",
    "write_count",
]
METRICS_TABLE_COLUMNS = ["timestamp", "machine", *METRIC_COLUMNS]

# Injected failures, as scaled levels per overwritten metric.
FAILURE_SCENARIOS = {
    "memory_leak_oom": {"avg_mem": 1.4, "max_mem": 1.6},
    "cpu_runaway_deadlock": {
        "cpu_usage": 1.6,
        "read": 0.0,
        "write": 0.0,
        "read_count": 0.0,
        "write_count": 0.0,
    },
    "gpu_crash_cuda_oom": {"gpu_wrk_util": 0.0, "avg_gpu_wrk_mem": 1.6, "max_gpu_wrk_mem": 1.6},
    "network_ddos": {
        "read": 1.7,
        "read_count": 1.7,
        "cpu_usage": 1.4,
        "avg_mem": 1.3,
        "max_mem": 1.4,
    },
    "silent_death": {metric: 0.0 for metric in METRIC_COLUMNS},
}


@dataclass(frozen=True)
class Settings:
    """Parameters of the failure-prediction jobs."""

    bucket_seconds: int = 30
    tick_seconds: int = 5
    lookback: int = 20
    horizon_minutes: float = 5
    watermark: str = "2 minutes"
    train_ratio: float = 0.7
    val_ratio: float = 0.15
    missing_max: float = 0.8
    missing_on: str = "scaled"
    depth: int = 6
    rounds: int = 250
    rate: float = 0.05
    seed: int = 42
