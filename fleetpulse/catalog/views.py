"""Telemetry, server metrics and scores derived from the ``events`` table.

Each view is one SQL text with a few engine-specific spellings, so that Spark and the
checking engine read identical inputs. Every row of ``events`` is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.config import Settings
from fleetpulse.session import configure

# Four-hour windows, two expected events, one day ahead: the events table holds about
# two events per user and day.
SETTINGS = Settings(bucket_seconds=14400, tick_seconds=7200, horizon_minutes=1440)
ALERT_WINDOW, ALERT_SLIDE, ALERT_SLIDE_SECONDS, QUIET_MINUTES = "24 hours", "12 hours", 43200, 7200

SPARK = {
    "STR": "STRING",
    "TS": "CAST(ts AS TIMESTAMP)",
    "EPOCH": "unix_seconds(CAST(ts AS TIMESTAMP))",
    "K": "CAST(get_json_object(props, '$.k') AS INT)",
    "DIV": "div",
    "LOG_TEXT": "date_format(timestamp_seconds(epoch_at), 'dd-MM-yy HH:mm:ss')",
    "DAY_TEXT": "date_format(timestamp_seconds(epoch_at), 'dd/MM/yyyy HH:mm:ss')",
}
DUCK = {
    "STR": "VARCHAR",
    "TS": "ts",
    "EPOCH": "CAST(epoch_us(ts) // 1000000 AS BIGINT)",
    "K": "CAST(json_extract_string(props, '$.k') AS INT)",
    "DIV": "//",
    "LOG_TEXT": "strftime(make_timestamp(epoch_at * 1000000), '%d-%m-%y %H:%M:%S')",
    "DAY_TEXT": "strftime(make_timestamp(epoch_at * 1000000), '%d/%m/%Y %H:%M:%S')",
}

_TELEMETRY = """
SELECT machine_id, cluster_id, role, event_time, event_ts, sequence_no,
  CASE WHEN sequence_no % 29 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS cpu_pct,
  least(CAST(100 AS DOUBLE), value) AS mem_pct,
  CASE WHEN m % 5 = 4 THEN CAST(100 - k AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS gpu_util_pct,
  CASE WHEN m % 5 = 4 THEN least(CAST(100 AS DOUBLE), value) ELSE CAST(0 AS DOUBLE) END AS gpu_mem_pct,
  CAST(sequence_no % 100 AS DOUBLE) AS disk_used_pct,
  CAST((k * 7) % 50 AS DOUBLE) AS disk_io_wait_pct,
  CAST(k * 1000 + sequence_no % 1000 AS BIGINT) AS net_rx_bytes,
  CAST(k * 700 + sequence_no % 700 AS BIGINT) AS net_tx_bytes,
  CAST(k % 10 AS DOUBLE) / CAST(2 AS DOUBLE) AS net_retransmit_pct,
  CAST(20 * (sequence_no % 50) AS DOUBLE) AS request_rate,
  CAST(CASE WHEN event_type = 'error' THEN k % 15 ELSE 0 END AS INT) AS error_count,
  CAST(5 AS DOUBLE) + value AS latency_p95_ms,
  CAST(k % 40 AS DOUBLE) AS queue_depth,
  CASE WHEN event_type = 'signup' AND k > 90 THEN 1 ELSE 0 END AS restart_count,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 0 ELSE 1 END AS heartbeat_ok,
  CASE WHEN fail = 1 THEN concat(machine_id, '-', CAST(sequence_no AS {STR})) END AS gt_incident_id,
  CASE WHEN fail = 0 THEN 'none' WHEN k % 3 = 0 THEN 'memory_leak'
       WHEN k % 3 = 1 THEN 'disk_exhaustion' ELSE 'app_crash' END AS gt_failure_type,
  CASE WHEN fail = 1 THEN 3 WHEN event_type = 'click' AND k < 20 THEN 1
       WHEN event_type = 'purchase' AND k < 20 THEN 2
       WHEN event_type = 'signup' AND k > 90 THEN 4 ELSE 0 END AS gt_phase_code,
  CASE WHEN fail = 1 THEN event_time END AS gt_failure_start_ts,
  fail AS gt_is_failure_now
FROM (
  SELECT user_id AS m, concat('server_', CAST(user_id AS {STR})) AS machine_id,
    concat('cluster_', CAST((user_id + {EPOCH} {DIV} 1296000) % 2 AS {STR})) AS cluster_id,
    CASE user_id % 5 WHEN 0 THEN 'api' WHEN 1 THEN 'web' WHEN 2 THEN 'db' WHEN 3 THEN 'cache' ELSE 'gpu' END AS role,
    {TS} AS event_time, {EPOCH} AS event_ts, event_id AS sequence_no, {K} AS k, value, event_type,
    CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END AS fail
  FROM {events}
) e
"""

# Time runs faster per machine, so that machines span from under one to over four days.
_METRICS = """
SELECT CASE WHEN event_id % 53 = 0 THEN 'n/a' WHEN event_id % 5 = 1 THEN {DAY_TEXT}
            WHEN event_id % 2 = 0 THEN {LOG_TEXT} ELSE CAST(epoch_at AS {STR}) END AS timestamp,
  CASE WHEN event_id % 61 = 0 THEN NULL WHEN event_id % 67 = 0 THEN '  '
       ELSE concat(' m', CAST(user_id AS {STR})) END AS machine,
  CASE WHEN event_id % 37 = 0 THEN 'bad' ELSE CAST(k AS {STR}) END AS cpu_usage,
  CAST(100 - k AS {STR}) AS gpu_wrk_util, CAST(k % 60 AS {STR}) AS avg_mem,
  CAST(k % 60 + 10 AS {STR}) AS max_mem, CAST(k % 30 AS {STR}) AS avg_gpu_wrk_mem,
  CAST(k % 30 + 5 AS {STR}) AS max_gpu_wrk_mem,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(event_id % 997 AS {STR}) END AS read,
  CAST(event_id % 499 AS {STR}) AS write, CAST(event_id % 97 AS {STR}) AS read_count,
  CAST(event_id % 89 AS {STR}) AS write_count
FROM (
  SELECT event_id, user_id, {K} AS k,
    CASE WHEN event_id % 43 = 0 THEN 1704067200 ELSE 1735689600 END
      + ({EPOCH} - 1704067200) {DIV} CASE user_id % 5 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 12
                                               WHEN 3 THEN 9 ELSE 7 END AS epoch_at
  FROM {events}
) e
"""

_SCORES = """
SELECT concat('server_', CAST(user_id AS {STR})) AS machine_id, {TS} AS window_end, event_id AS seq,
  CAST({K} AS DOUBLE) / CAST(100 AS DOUBLE) AS p_fail_5m,
  CASE WHEN {K} + (event_id % 40) > 90 THEN 1 ELSE 0 END AS label,
  CAST(event_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS missing_ratio
FROM {events}
"""


def duck_views() -> dict[str, str]:
    filled = DUCK | {"events": "events"}
    return {
        "telemetry": _TELEMETRY.format(**filled),
        "metrics_text": _METRICS.format(**filled),
        "scores": _SCORES.format(**filled),
    }


def _spark_view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(text.format(**SPARK, events="{events}"), events=events)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, _TELEMETRY)


def telemetry_from(events: DataFrame) -> DataFrame:
    """The telemetry view over any events frame, streaming ones included."""
    return events.sparkSession.sql(_TELEMETRY.format(**SPARK, events="{events}"), events=events)


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, _METRICS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, _SCORES)


def scores_from(events: DataFrame) -> DataFrame:
    """The scores view over any events frame."""
    return events.sparkSession.sql(_SCORES.format(**SPARK, events="{events}"), events=events)
