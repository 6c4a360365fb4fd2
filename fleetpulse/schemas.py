"""Row types of every table and stream."""

from __future__ import annotations

from pyspark.sql import types as T

from fleetpulse.config import METRICS_TABLE_COLUMNS


_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; usable before a session exists, unlike ``fromDDL``."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# event_time and gt_failure_start_ts travel as ISO-8601 text.
RAW_WIRE = _struct(
    """event_time STRING, event_ts BIGINT, machine_id STRING, cluster_id STRING, role STRING,
    sequence_no BIGINT, cpu_pct DOUBLE, mem_pct DOUBLE, gpu_util_pct DOUBLE, gpu_mem_pct DOUBLE,
    disk_used_pct DOUBLE, disk_io_wait_pct DOUBLE, net_rx_bytes BIGINT, net_tx_bytes BIGINT,
    net_retransmit_pct DOUBLE, request_rate DOUBLE, error_count INT, latency_p95_ms DOUBLE,
    queue_depth DOUBLE, restart_count INT, heartbeat_ok INT, gt_incident_id STRING,
    gt_failure_type STRING, gt_phase STRING, gt_phase_code INT, gt_failure_start_ts STRING,
    gt_time_to_failure_sec INT, gt_is_failure_now INT"""
)
RAW_COLUMNS = RAW_WIRE.fieldNames()

# The online path ignores what only the training path needs.
_TRAINING_ONLY = {
    "gt_incident_id",
    "gt_failure_type",
    "gt_phase",
    "gt_failure_start_ts",
    "gt_time_to_failure_sec",
}
DECODED = T.StructType([f for f in RAW_WIRE.fields if f.name not in _TRAINING_ONLY])

FEATURE_WINDOW = _struct(
    """window_start TIMESTAMP, window_end TIMESTAMP, machine_id STRING, cluster_id STRING,
    role STRING, cpu_pct_mean DOUBLE, cpu_pct_max DOUBLE, mem_pct_mean DOUBLE, mem_pct_max DOUBLE,
    gpu_util_pct_mean DOUBLE, gpu_mem_pct_mean DOUBLE, disk_used_pct_mean DOUBLE,
    disk_io_wait_pct_mean DOUBLE, disk_io_wait_pct_max DOUBLE, net_rx_bytes_sum BIGINT,
    net_tx_bytes_sum BIGINT, net_retransmit_pct_mean DOUBLE, request_rate_mean DOUBLE,
    latency_p95_ms_mean DOUBLE, latency_p95_ms_max DOUBLE, error_count_sum BIGINT,
    queue_depth_mean DOUBLE, restart_count_sum BIGINT, heartbeat_ok_mean DOUBLE,
    event_count BIGINT, missing_ratio DOUBLE, gt_phase_code_max INT, gt_is_failure_now_max INT"""
)

PREDICTION = _struct(
    """@timestamp TIMESTAMP, machine_id STRING, cluster_id STRING, role STRING,
    window_start TIMESTAMP, window_end TIMESTAMP, p_fail_5m DOUBLE, risk_band STRING,
    predicted_failure_type STRING, alert_fired BOOLEAN, threshold DOUBLE, model_version STRING,
    missing_ratio DOUBLE, cpu_pct_mean DOUBLE, mem_pct_mean DOUBLE, latency_p95_ms_mean DOUBLE,
    error_count_sum DOUBLE, queue_depth_mean DOUBLE, net_retransmit_pct_mean DOUBLE"""
)

METRICS_TEXT = T.StructType([T.StructField(name, T.StringType()) for name in METRICS_TABLE_COLUMNS])

# Types of the searchable tables: measures are single precision there.
_SEARCH_LONGS = {"net_rx_bytes_sum", "net_tx_bytes_sum"}


def _search_types(schema: T.StructType, integers: set[str]) -> T.StructType:
    def narrowed(field: T.StructField) -> T.StructField:
        if field.name in integers:
            return T.StructField(field.name, T.IntegerType())
        if field.name in _SEARCH_LONGS:
            return T.StructField(field.name, T.LongType())
        if isinstance(field.dataType, (T.DoubleType, T.LongType)):
            return T.StructField(field.name, T.FloatType())
        return field

    return T.StructType([narrowed(field) for field in schema.fields])


SEARCH_FEATURE_WINDOW = _search_types(
    FEATURE_WINDOW, {"event_count", "gt_phase_code_max", "gt_is_failure_now_max"}
)
SEARCH_PREDICTION = _search_types(PREDICTION, set())

_SCALER = T.StructType(
    [T.StructField("feature_columns", T.ArrayType(T.StringType()))]
    + [
        T.StructField(name, T.ArrayType(T.DoubleType()))
        for name in ("data_min", "data_max", "scale", "min")
    ]
)
MANIFEST = T.StructType(
    _struct(
        """model_version STRING, model_type STRING, model_backend STRING, lookback_steps INT,
        bucket_seconds INT, tick_seconds INT, horizon_minutes DOUBLE"""
    ).fields
    + [
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("scaler", _SCALER),
    ]
    + _struct(
        """threshold DOUBLE, train_sequences BIGINT, validation_sequences BIGINT,
        test_sequences BIGINT, positive_train_sequences BIGINT"""
    ).fields
    + [
        T.StructField(
            "test_metrics",
            _struct("roc_auc DOUBLE, pr_auc DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE"),
        ),
        T.StructField("model_file", T.StringType()),
    ]
)
