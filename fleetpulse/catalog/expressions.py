"""Table expressions of the checking SQL: each step of the jobs, written independently."""

from __future__ import annotations

from fleetpulse.catalog.registry import CTES
from fleetpulse.catalog.views import SETTINGS, duck_views
from fleetpulse.config import METRIC_COLUMNS, MODEL_COLUMNS

BUCKET_US = SETTINGS.bucket_seconds * 1_000_000
HORIZON_US = SETTINGS.horizon_minutes * 60_000_000
EXPECTED = 2
LAST = SETTINGS.lookback - 1

CTES.update(duck_views())

_MEANS = (
    "cpu_pct mem_pct gpu_util_pct gpu_mem_pct disk_used_pct disk_io_wait_pct net_retransmit_pct "
    "request_rate latency_p95_ms queue_depth heartbeat_ok"
).split()
_MAXES = "cpu_pct mem_pct disk_io_wait_pct latency_p95_ms".split()
_TOTALS = "net_rx_bytes net_tx_bytes error_count restart_count".split()
_AGGREGATES = ", ".join(
    [f"avg({c}) AS {c}_mean" for c in _MEANS]
    + [f"max({c}) AS {c}_max" for c in _MAXES]
    + [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}_sum" for c in _TOTALS]
    + ["max(gt_phase_code) AS gt_phase_code_max", "max(gt_is_failure_now) AS gt_is_failure_now_max"]
)
_CARRY = [f"{c}_mean" for c in _MEANS] + [f"{c}_max" for c in _MAXES]
_ZERO = [f"{c}_sum" for c in _TOTALS] + ["event_count", "gt_phase_code_max", "gt_is_failure_now_max"]

CTES["observed"] = f"""SELECT machine_id, epoch_us(event_time) // {BUCKET_US} AS b, {_AGGREGATES},
  count(sequence_no) AS event_count FROM telemetry GROUP BY 1, 2"""
CTES["identities"] = """SELECT machine_id, arg_min(cluster_id, event_time) AS cluster_id,
  arg_min(role, event_time) AS role, min(event_time) AS first_seen, max(event_time) AS last_seen
  FROM telemetry GROUP BY 1"""
CTES["spine"] = f"""SELECT machine_id, cluster_id, role,
  unnest(generate_series(epoch_us(first_seen) // {BUCKET_US}, epoch_us(last_seen) // {BUCKET_US})) AS b
  FROM identities"""
CTES["dense"] = f"""SELECT *, make_timestamp(b * {BUCKET_US}) AS window_start,
  make_timestamp((b + 1) * {BUCKET_US}) AS window_end FROM spine LEFT JOIN observed USING (machine_id, b)"""
CTES["batch_windows"] = f"""SELECT machine_id, cluster_id, role, b, window_start, window_end,
  {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER fill, 0e0) AS {c}" for c in _CARRY)},
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in _ZERO)},
  1e0 - least(coalesce(event_count, 0), {EXPECTED}) / {EXPECTED}e0 AS missing_ratio
  FROM dense WINDOW fill AS (PARTITION BY machine_id ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
CTES["stream_windows"] = f"""SELECT machine_id, cluster_id, role,
  make_timestamp(b * {BUCKET_US}) AS window_start, make_timestamp((b + 1) * {BUCKET_US}) AS window_end,
  * EXCLUDE (machine_id, cluster_id, role, b), ({EXPECTED}e0 - event_count) / {EXPECTED}e0 AS missing_ratio
  FROM (SELECT machine_id, cluster_id, role, epoch_us(event_time) // {BUCKET_US} AS b, {_AGGREGATES},
        count(*) AS event_count FROM telemetry GROUP BY 1, 2, 3, 4)"""
CTES["labelled"] = f"""SELECT * EXCLUDE next_us,
  CASE WHEN next_us - epoch_us(window_end) <= {HORIZON_US} THEN 1 ELSE 0 END AS target_failure_within_horizon,
  CASE WHEN next_us - epoch_us(window_end) <= {HORIZON_US} THEN next_us - epoch_us(window_end) END AS lead_time_us,
  gt_is_failure_now_max = 0 AND gt_phase_code_max <= 2 AS eligible_for_training
  FROM (SELECT w.*, (SELECT min(epoch_us(t.gt_failure_start_ts)) FROM telemetry t
          WHERE t.machine_id = w.machine_id AND t.gt_incident_id IS NOT NULL
            AND t.gt_failure_start_ts > w.window_end) AS next_us FROM batch_windows w)"""
CTES["derived"] = """SELECT *,
  coalesce(cpu_pct_mean - lag(cpu_pct_mean) OVER h, 0e0) AS cpu_delta,
  coalesce(mem_pct_mean - lag(mem_pct_mean) OVER h, 0e0) AS mem_delta,
  coalesce(latency_p95_ms_mean - lag(latency_p95_ms_mean) OVER h, 0e0) AS latency_delta,
  coalesce(queue_depth_mean - lag(queue_depth_mean) OVER h, 0e0) AS queue_delta,
  CAST(net_rx_bytes_sum + net_tx_bytes_sum AS DOUBLE) AS throughput_total,
  1e0 - heartbeat_ok_mean AS heartbeat_drop_ratio,
  error_count_sum / greatest(request_rate_mean, 1e0) AS error_rate
  FROM labelled WINDOW h AS (PARTITION BY machine_id ORDER BY b)"""
CTES["cutoffs"] = """SELECT quantile_cont(epoch_us(window_end), 0.7) AS train_cutoff,
  quantile_cont(epoch_us(window_end), 0.85) AS val_cutoff FROM batch_windows"""
CTES["model_rows"] = """SELECT derived.*, CASE WHEN epoch_us(window_end) <= train_cutoff THEN 'train'
  WHEN epoch_us(window_end) <= val_cutoff THEN 'validation' ELSE 'test' END AS split FROM derived, cutoffs"""
CTES["scaler"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS data_min, CAST(max({c}) AS DOUBLE) AS data_max
    FROM model_rows WHERE split = 'train'"""
    for c in MODEL_COLUMNS
)
CTES["scaler_params"] = """SELECT *, -data_min * scale AS "min" FROM (SELECT *,
  CASE WHEN data_max = data_min THEN 1e0 ELSE 1e0 / (data_max - data_min) END AS scale FROM scaler)"""
CTES["scaler_row"] = "SELECT " + ", ".join(
    f"""max(scale) FILTER (feature = '{c}') AS scale_{c}, max("min") FILTER (feature = '{c}') AS min_{c}"""
    for c in MODEL_COLUMNS
) + " FROM scaler_params"
_SCALED = ", ".join(f"CAST({c} * scale_{c} + min_{c} AS FLOAT) AS {c}" for c in MODEL_COLUMNS)
CTES["scaled_rows"] = f"""SELECT machine_id, split, b, window_end, target_failure_within_horizon AS label,
  lead_time_us, eligible_for_training, {_SCALED} FROM model_rows, scaler_row"""
_ROW_TOTAL = " + ".join(f"CAST({c} AS DOUBLE)" for c in MODEL_COLUMNS)
CTES["framed_rows"] = f"""SELECT *, count(*) OVER f AS steps, avg(CAST(missing_ratio AS DOUBLE)) OVER f AS mean_missing,
  sum(row_total) OVER f AS element_sum, CAST(first_value(cpu_pct_mean) OVER f AS DOUBLE) AS first_element,
  CAST(missing_ratio AS DOUBLE) AS last_element FROM (SELECT *, {_ROW_TOTAL} AS row_total FROM scaled_rows)
  WINDOW f AS (PARTITION BY split, machine_id ORDER BY b ROWS BETWEEN {LAST} PRECEDING AND CURRENT ROW)"""
CTES["kept_sequences"] = f"""SELECT * FROM framed_rows
  WHERE steps = {SETTINGS.lookback} AND eligible_for_training AND mean_missing <= {SETTINGS.missing_max}"""

# Server metrics, exploratory path.
CTES["typed_metrics"] = f"""SELECT ts AS timestamp, CASE WHEN trim(coalesce(machine, '')) = '' THEN 'unknown'
    ELSE trim(machine) END AS machine,
  {", ".join(f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}" for c in METRIC_COLUMNS)}
  FROM (SELECT * EXCLUDE timestamp, coalesce(try_strptime(timestamp, '%d-%m-%y %H:%M:%S'),
          try_strptime(timestamp, '%d/%m/%Y %H:%M:%S')) AS ts FROM metrics_text) WHERE ts IS NOT NULL"""
CTES["machine_filled"] = f"""SELECT t.timestamp, t.machine,
  {", ".join(f"coalesce(t.{c}, m.{c}) AS {c}" for c in METRIC_COLUMNS)} FROM typed_metrics t
  JOIN (SELECT machine, {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in METRIC_COLUMNS)}
        FROM typed_metrics GROUP BY 1) m USING (machine)"""
CTES["explored"] = f"""SELECT timestamp, machine, {", ".join(f"coalesce(f.{c}, g.{c}) AS {c}" for c in METRIC_COLUMNS)}
  FROM machine_filled f,
  (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in METRIC_COLUMNS)} FROM machine_filled) g"""
# Server metrics, anomaly path.
CTES["timed_metrics"] = f"""SELECT coalesce(make_timestamp(CAST(round(TRY_CAST(timestamp AS DOUBLE) * 1e6) AS BIGINT)),
  try_strptime(timestamp, '%d-%m-%y %H:%M:%S')) AS timestamp, machine,
  {", ".join(f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}" for c in METRIC_COLUMNS)} FROM metrics_text"""
CTES["clean_rows"] = f"""SELECT * FROM timed_metrics WHERE timestamp IS NOT NULL AND machine IS NOT NULL
  AND year(timestamp) >= 2025 AND {" AND ".join(f"{c} IS NOT NULL" for c in METRIC_COLUMNS)}"""
CTES["short_spans"] = """SELECT machine FROM clean_rows GROUP BY 1
  HAVING (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 86400000000 <= 2"""
CTES["minutes"] = f"""SELECT machine, date_trunc('minute', timestamp) AS minute,
  {", ".join(f"avg({c}) AS {c}" for c in METRIC_COLUMNS)} FROM clean_rows
  WHERE machine IN (SELECT machine FROM short_spans) GROUP BY 1, 2"""


def _machine_scaled(c: str) -> str:
    scale = f"CASE WHEN hi_{c} = lo_{c} THEN 1e0 ELSE 1e0 / (hi_{c} - lo_{c}) END"
    return f"{c} * ({scale}) + (-lo_{c} * ({scale})) AS {c}"


CTES["scaled_minutes"] = f"""SELECT machine, minute, minutes,
  {", ".join(_machine_scaled(c) for c in METRIC_COLUMNS)}
  FROM minutes JOIN (SELECT machine, count(*) AS minutes,
    {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in METRIC_COLUMNS)}
    FROM minutes GROUP BY 1) USING (machine)"""
_TOTAL = " + ".join(METRIC_COLUMNS)
_SQUARES = " + ".join(f"{c} * {c}" for c in METRIC_COLUMNS)
CTES["metric_frames"] = f"""SELECT machine, start, "end", n - 10 AS idx, element_sum, mean_square, first_element, last_element,
  {", ".join(f"total_{c}" for c in METRIC_COLUMNS)}, row_number() OVER (ORDER BY machine, "end") - 1 AS position FROM (
  SELECT machine, minutes, minute AS "end", first_value(minute) OVER f AS start, row_number() OVER t AS n,
    sum({_TOTAL}) OVER f AS element_sum, sum({_SQUARES}) OVER f / 100 AS mean_square,
    {", ".join(f"sum({c}) OVER f AS total_{c}" for c in METRIC_COLUMNS)},
    first_value(cpu_usage) OVER f AS first_element, write_count AS last_element
  FROM scaled_minutes WHERE minutes > 10
  WINDOW t AS (PARTITION BY machine ORDER BY minute),
         f AS (PARTITION BY machine ORDER BY minute ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  WHERE n >= 10 AND n < minutes"""
CTES["split_frames"] = """SELECT *, CASE WHEN position < total - ceil(total * 0.2e0) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, count(*) OVER () AS total FROM metric_frames)"""

# Scores.
CTES["score_points"] = "SELECT p_fail_5m AS score, sum(label) AS pos, count(*) AS n FROM scores GROUP BY 1"
CTES["score_curve"] = """SELECT score, pos, n, sum(pos) OVER d AS pos_above, sum(n) OVER d AS n_above,
  sum(pos) OVER () AS total_pos, sum(n) OVER () AS total_n FROM score_points WINDOW d AS (ORDER BY score DESC)"""
CTES["pr_points"] = """SELECT *, (2 * precision * recall) / (precision + recall + 1e-12) AS f1 FROM (
  SELECT score, pos_above / n_above AS precision, pos_above / total_pos AS recall FROM score_curve)"""
CTES["predictions"] = """SELECT *, CASE WHEN p_fail_5m >= greatest(0.95e0, 0.6e0 + 0.12e0) THEN 'critical'
  WHEN p_fail_5m >= 0.6e0 THEN 'high' WHEN p_fail_5m >= 0.6e0 * 0.7e0 THEN 'medium' ELSE 'low' END AS risk_band FROM scores"""
CTES["evaluations"] = """SELECT machine_id, e, make_timestamp(e * 43200000000) AS eval_at, max(p_fail_5m) AS max_score,
  max(p_fail_5m) > 0.8e0 AS breached FROM (SELECT *, unnest([epoch_us(window_end) // 43200000000 + 1,
    epoch_us(window_end) // 43200000000 + 2]) AS e FROM scores) GROUP BY 1, 2"""
CTES["confirmations"] = """SELECT *, count(*) FILTER (breached) OVER two = 2 AS confirmed,
  count(*) FILTER (NOT breached) OVER three = 3 AS calm FROM evaluations
  WINDOW two AS (PARTITION BY machine_id ORDER BY e RANGE BETWEEN 1 PRECEDING AND CURRENT ROW),
         three AS (PARTITION BY machine_id ORDER BY e RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"""
CTES["recoveries"] = """SELECT *, calm AND coalesce(last_value(event IGNORE NULLS) OVER earlier, 0) = 1 AS recovered
  FROM (SELECT *, CASE WHEN confirmed THEN 1 WHEN calm THEN 0 END AS event FROM confirmations)
  WINDOW earlier AS (PARTITION BY machine_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
