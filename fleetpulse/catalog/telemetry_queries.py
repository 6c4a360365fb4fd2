"""Checked queries over telemetry: sources, validation, windows, labels, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.catalog import expressions as _expressions  # noqa: F401  (registers the SQL)
from fleetpulse.catalog.registry import query
from fleetpulse.catalog.views import SETTINGS, telemetry
from fleetpulse.config import MODEL_COLUMNS
from fleetpulse.functions.parsing import missing_ratio
from fleetpulse.functions.vectors import flatten_features
from fleetpulse.operators import cleaning, derived, labels, splitting, windows
from fleetpulse.operators.ordered import grid_slices, own_rows, with_position
from fleetpulse.operators.sequences import sequences
from fleetpulse.plans.training import build_training_frame, prepare_datasets
from fleetpulse.schemas import (
    DECODED,
    RAW_COLUMNS,
    SEARCH_FEATURE_WINDOW,
)
from fleetpulse.session import scratch_path, stage
from fleetpulse.sources.files import (
    conform,
    read_feature_windows,
    read_raw_history,
    write_jsonl,
)
from fleetpulse.sources.topics import decode_events, keyed_payload

BUCKET, TICK = SETTINGS.bucket_seconds, SETTINGS.tick_seconds

_IDENTITY = "machine_id cluster_id role"
_EVENT_MEASURES = (
    "cpu_pct:4 mem_pct:4 gpu_util_pct:4 gpu_mem_pct:4 disk_used_pct:4 disk_io_wait_pct:4 "
    "net_rx_bytes:i net_tx_bytes:i net_retransmit_pct:4 request_rate:4 error_count:i "
    "latency_p95_ms:4 queue_depth:4 restart_count:i heartbeat_ok:i gt_phase_code:i gt_is_failure_now:i"
)
EVENT = f"{_IDENTITY} event_time:us event_ts:i sequence_no:i {_EVENT_MEASURES}"
WINDOW_MEASURES = (
    "cpu_pct_mean:4 cpu_pct_max:4 mem_pct_mean:4 mem_pct_max:4 gpu_util_pct_mean:4 "
    "gpu_mem_pct_mean:4 disk_used_pct_mean:4 disk_io_wait_pct_mean:4 disk_io_wait_pct_max:4 "
    "net_rx_bytes_sum:i net_tx_bytes_sum:i net_retransmit_pct_mean:4 request_rate_mean:4 "
    "latency_p95_ms_mean:4 latency_p95_ms_max:4 error_count_sum:i queue_depth_mean:4 "
    "restart_count_sum:i heartbeat_ok_mean:4 event_count:i gt_phase_code_max:i gt_is_failure_now_max:i"
)
WINDOW = f"window_start:us window_end:us {_IDENTITY} {WINDOW_MEASURES} missing_ratio:4"
DERIVED = (
    "cpu_delta:4 mem_delta:4 latency_delta:4 queue_delta:4 throughput_total:4 "
    "heartbeat_drop_ratio:4 error_rate:8"
)
KEY = "machine_id window_end:us"


def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.feature_windows(telemetry(spark, sf_dir), BUCKET, TICK)


def stream_shaped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.feature_windows(telemetry(spark, sf_dir), BUCKET, TICK, mode="stream")


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with its times as ISO text, as producers send it."""
    text = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    return telemetry(spark, sf_dir).withColumns(
        {
            "event_time": F.date_format("event_time", text),
            "gt_failure_start_ts": F.date_format("gt_failure_start_ts", text),
        }
    )


# ---- sources and sinks


@query("a1_raw_history", f"{EVENT} gt_incident_id gt_failure_type gt_failure_start_ts:us", "telemetry")
def _(spark, sf_dir):
    path = scratch_path(spark, "raw-history")
    wire_events(spark, sf_dir).write.json(path)
    return read_raw_history(spark, path)


@query("a3_decoded_events", EVENT, "telemetry")
def _(spark, sf_dir):
    return decode_events(keyed_payload(wire_events(spark, sf_dir)))


@query("a5_exported_windows", WINDOW, "batch_windows")
def _(spark, sf_dir):
    path = scratch_path(spark, "windows")
    write_jsonl(batch_windows(spark, sf_dir), path, compression="gzip")
    return read_feature_windows(spark, path)


@query(
    "a6_window_payload",
    "key window_end:us cpu_pct_mean:4 net_rx_bytes_sum:i missing_ratio:4",
    "SELECT machine_id AS key, * FROM stream_windows",
)
def _(spark, sf_dir):
    payload = keyed_payload(stream_shaped_windows(spark, sf_dir))
    fields = "window_end TIMESTAMP, cpu_pct_mean DOUBLE, net_rx_bytes_sum BIGINT, missing_ratio DOUBLE"
    return payload.select("key", F.from_json("value", fields).alias("w")).select("key", "w.*")


@query("a8_window_scan", f"{KEY} cpu_pct_mean:4 event_count:i missing_ratio:4", "stream_windows")
def _(spark, sf_dir):
    path = scratch_path(spark, "stream-windows")
    write_jsonl(stream_shaped_windows(spark, sf_dir), path, mode="append")
    return read_feature_windows(spark, path)


@query(
    "a13_search_windows",
    f"{KEY} cpu_pct_mean:2 error_count_sum:2 event_count:i net_rx_bytes_sum:i missing_ratio:2",
    "SELECT *, CAST(cpu_pct_mean AS FLOAT) AS f FROM batch_windows",
)
def _(spark, sf_dir):
    return conform(batch_windows(spark, sf_dir), SEARCH_FEATURE_WINDOW)


# ---- validation, expressions

_PAYLOADS = """SELECT machine_id, sequence_no, CASE WHEN gt_phase_code = 4 THEN 'malformed'
  WHEN gt_phase_code = 1 THEN 'missing: role' END AS reason FROM telemetry"""


@query("b1_checked_events", "sequence reason", f"SELECT sequence_no AS sequence, reason FROM ({_PAYLOADS})")
def _(spark, sf_dir):
    # Unfinished JSON in recovery, no role under stress, a null (but present) role when degraded.
    wire = wire_events(spark, sf_dir).withColumn("has_role", F.col("gt_phase_code") != 1)
    body = F.to_json(F.struct(*[c for c in DECODED.fieldNames() if c != "role"]), {"ignoreNullFields": "false"})
    role = F.when(F.col("gt_phase_code") == 2, "null").otherwise(F.concat(F.lit('"'), "role", F.lit('"')))
    with_role = F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"role":'), role, F.lit("}"))
    value = (
        F.when(F.col("gt_phase_code") == 4, F.expr("substring(body, 1, length(body) - 1)"))
        .when(F.col("has_role"), with_role)
        .otherwise(F.col("body"))
    )
    payloads = wire.withColumn("body", body).select(F.col("sequence_no").alias("sequence"), value.alias("value"))
    return cleaning.check_events(payloads, DECODED.fieldNames())


@query("b12_missing_ratio", f"{KEY} missing_ratio:4", "batch_windows")
def _(spark, sf_dir):
    return batch_windows(spark, sf_dir)


@query("b13_stream_missing_ratio", f"{KEY} missing_ratio:4", "stream_windows")
def _(spark, sf_dir):
    return stream_shaped_windows(spark, sf_dir)


@query("b14_training_eligibility", f"{KEY} eligible_for_training:i", "labelled")
def _(spark, sf_dir):
    return build_training_frame(telemetry(spark, sf_dir), SETTINGS)


@query("b15_throughput", f"{KEY} throughput_total:4", "derived")
@query("b16_heartbeat_drop", f"{KEY} heartbeat_drop_ratio:4", "derived")
@query("b17_error_rate", f"{KEY} error_rate:8", "derived")
def _(spark, sf_dir):
    return batch_windows(spark, sf_dir).withColumns(derived.row_columns())


# ---- de-duplication and incidents


@query("c1_deduplicated_events", EVENT, "telemetry")
def _(spark, sf_dir):
    once = telemetry(spark, sf_dir)
    redelivered = once.where("heartbeat_ok = 0 OR gt_phase_code = 2")
    return cleaning.dedupe_events(once.unionByName(redelivered))


@query(
    "c2_incidents",
    "machine_id gt_incident_id gt_failure_type gt_failure_start_ts:us",
    """SELECT DISTINCT machine_id, gt_incident_id, gt_failure_type, gt_failure_start_ts FROM telemetry
       WHERE gt_incident_id IS NOT NULL AND gt_failure_start_ts IS NOT NULL""",
)
def _(spark, sf_dir):
    return cleaning.incidents(telemetry(spark, sf_dir))


# ---- windows


@query("d1_bucket_aggregate", f"machine_id window_start:us {WINDOW_MEASURES}",
       f"SELECT *, make_timestamp(b * {BUCKET}000000) AS window_start FROM observed")
def _(spark, sf_dir):
    return windows.observed_buckets(telemetry(spark, sf_dir), BUCKET)


@query("d2_stream_buckets", WINDOW, "stream_windows")
def _(spark, sf_dir):
    return stream_shaped_windows(spark, sf_dir)


@query("d3_machine_identity", f"{_IDENTITY} first_seen:us last_seen:us", "identities")
def _(spark, sf_dir):
    return windows.machine_identity(telemetry(spark, sf_dir))


@query("d4_feature_windows", WINDOW, "batch_windows")
def _(spark, sf_dir):
    return batch_windows(spark, sf_dir)


@query("j2_dense_spine", f"{_IDENTITY} window_start:us event_count:i cpu_pct_mean:4", "dense")
def _(spark, sf_dir):
    return windows.dense_buckets(telemetry(spark, sf_dir), BUCKET)


@query("e1_forward_fill", f"{KEY} cpu_pct_mean:4 mem_pct_max:4 latency_p95_ms_mean:4 net_rx_bytes_sum:i",
       "batch_windows")
def _(spark, sf_dir):
    return batch_windows(spark, sf_dir)


@query(
    "l1_ordered_events",
    "machine_id event_time:us sequence_no:i position:i",
    "SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY event_time) AS position FROM telemetry",
)
def _(spark, sf_dir):
    placed = with_position(telemetry(spark, sf_dir), ["machine_id"], "event_time", name="position")
    return cleaning.ordered(placed, ["machine_id", "event_time"])


# ---- labels, derived inputs, split, scaling, sequences


@query(
    "j1_failure_labels",
    f"{KEY} target_failure_within_horizon:i lead_time_us:i eligible_for_training:i",
    "labelled",
)
def _(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    labelled = labels.label_windows(
        batch_windows(spark, sf_dir), cleaning.incidents(events), SETTINGS.horizon_minutes
    )
    return labelled.withColumn("lead_time_us", F.round(F.col("lead_time_sec") * 1e6).cast("bigint"))


@query("e2_first_differences", f"{KEY} cpu_delta:4 mem_delta:4 latency_delta:4 queue_delta:4", "derived")
@query("e3_derived_features", f"{KEY} {DERIVED}", "derived")
def _(spark, sf_dir):
    return derived.add_derived(batch_windows(spark, sf_dir), BUCKET)


@query(
    "h3_labelled_model_rows",
    f"{WINDOW} {DERIVED} target_failure_within_horizon:i eligible_for_training:i lead_time_us:i",
    "derived",
)
def _(spark, sf_dir):
    frame = build_training_frame(telemetry(spark, sf_dir), SETTINGS)
    return frame.withColumn("lead_time_us", F.round(F.col("lead_time_sec") * 1e6).cast("bigint"))


@query("d20_time_cutoffs", "train_cutoff:i val_cutoff:i", "cutoffs")
def _(spark, sf_dir):
    return splitting.time_cutoffs(batch_windows(spark, sf_dir))


@query("e4_time_split", f"{KEY} split", "model_rows")
def _(spark, sf_dir):
    return splitting.split_by_time(stage(batch_windows(spark, sf_dir), "windows"))


@query("d21_scaler", "feature data_min:4 data_max:4 scale:6 min:6", "scaler_params")
def _(spark, sf_dir):
    return prepare_datasets(telemetry(spark, sf_dir), SETTINGS).scaler


_SCALED_SHOWN = " ".join(f"{c}:4" for c in MODEL_COLUMNS)


@query("j3_scaled_rows", f"{KEY} split {_SCALED_SHOWN}", "scaled_rows")
def _(spark, sf_dir):
    prepared = prepare_datasets(telemetry(spark, sf_dir), SETTINGS)
    return splitting.apply_minmax(prepared.rows, prepared.scaler)


_SINGLE = ", ".join(
    f"CAST({c} AS FLOAT) * CAST(scale_{c} AS FLOAT) + CAST(min_{c} AS FLOAT) AS {c}"
    for c in MODEL_COLUMNS
)


@query(
    "h7_saved_scaler",
    f"{KEY} {_SCALED_SHOWN}".replace(":4", ":6"),
    f"SELECT machine_id, window_end, {_SINGLE} FROM model_rows, scaler_row",
)
def _(spark, sf_dir):
    prepared = prepare_datasets(telemetry(spark, sf_dir), SETTINGS)
    return splitting.apply_minmax(prepared.rows, prepared.scaler, saved=True)


_SEQUENCE = f"split {KEY} label:i lead_time_us:i element_sum:4 first_element:5 last_element:5"


def described_sequences(built: DataFrame) -> DataFrame:
    flat = built.withColumn("flat", flatten_features("features"))
    return flat.withColumns(
        {
            "element_sum": F.aggregate("flat", F.lit(0.0), lambda a, x: a + x),
            "first_element": F.col("flat")[0],
            "last_element": F.element_at("flat", -1),
            "elements": F.size("flat"),
            "lead_time_us": F.round(F.col("lead_time_sec") * 1e6).cast("bigint"),
        }
    )


@query("e5_sequences", _SEQUENCE, "kept_sequences")
@query("e7_sequence_metadata", f"split {KEY} label:i lead_time_us:i", "kept_sequences")
@query(
    "h1_flat_vectors",
    f"split {KEY} elements:i element_sum:4",
    f"SELECT *, {SETTINGS.lookback * len(MODEL_COLUMNS)} AS elements FROM kept_sequences",
)
def _(spark, sf_dir):
    return described_sequences(prepare_datasets(telemetry(spark, sf_dir), SETTINGS).sequences)


@query(
    "e6_complete_frames",
    f"split {KEY} mean_missing:5 kept:i",
    f"""SELECT *, mean_missing <= {SETTINGS.missing_max} AS kept FROM framed_rows
        WHERE steps = {SETTINGS.lookback}""",
)
def _(spark, sf_dir):
    prepared = prepare_datasets(telemetry(spark, sf_dir), SETTINGS)
    scaled = splitting.apply_minmax(prepared.rows, prepared.scaler)
    framed, frame = grid_slices(
        scaled, ["split", "machine_id"], "window_end", BUCKET, back=SETTINGS.lookback - 1
    )
    steps = frame.rowsBetween(-(SETTINGS.lookback - 1), 0)
    measured = framed.withColumns(
        {
            "steps": F.count(F.lit(1)).over(steps),
            "mean_missing": F.avg(F.col("missing_ratio").cast("double")).over(steps),
        }
    )
    return (
        own_rows(measured)
        .where(F.col("steps") == SETTINGS.lookback)
        .withColumn("kept", F.col("mean_missing") <= SETTINGS.missing_max)
    )


@query(
    "d7_long_enough_machines",
    "machine_id rows:i",
    f"""SELECT machine_id, count(*) AS rows FROM batch_windows GROUP BY 1
        HAVING count(*) >= {SETTINGS.lookback}""",
)
def _(spark, sf_dir):
    return (
        batch_windows(spark, sf_dir)
        .groupBy("machine_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") >= SETTINGS.lookback)
    )


@query(
    "d23_class_balance",
    "positive:i negative:i positive_weight:4",
    """SELECT positive, negative, least(20e0, greatest(1e0, negative / greatest(1, positive))) AS positive_weight
       FROM (SELECT count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative
             FROM kept_sequences WHERE split = 'train')""",
)
def _(spark, sf_dir):
    built = prepare_datasets(telemetry(spark, sf_dir), SETTINGS).sequences
    return splitting.class_balance(built.where("split = 'train'"))


@query(
    "d24_dataset_summary",
    """train_sequences:i validation_sequences:i test_sequences:i positive_train_sequences:i
       positive_validation_sequences:i positive_test_sequences:i""",
    "SELECT "
    + ", ".join(
        f"""count(*) FILTER (split = '{s}') AS {s}_sequences,
            count(*) FILTER (split = '{s}' AND label = 1) AS positive_{s}_sequences"""
        for s in splitting.SPLITS
    )
    + " FROM kept_sequences",
)
def _(spark, sf_dir):
    return splitting.dataset_summary(prepare_datasets(telemetry(spark, sf_dir), SETTINGS).sequences)
