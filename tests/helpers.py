"""Small builders for hand-made inputs."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fleetpulse.schemas import FEATURE_WINDOW, RAW_WIRE

T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def events(spark, rows):
    """Typed events from dicts; ``t`` is seconds after the base time, the rest defaults."""
    base = {f.name: None for f in RAW_WIRE.fields}
    zero = {
        f.name: 0
        for f in RAW_WIRE.fields
        if f.dataType.typeName() in ("long", "integer") and not f.name.startswith("gt_time")
    }
    unit = {f.name: 1.0 for f in RAW_WIRE.fields if f.dataType.typeName() == "double"}
    filled = []
    for i, row in enumerate(rows):
        row = dict(row)
        seconds = row.pop("t")
        made = base | zero | unit | {
            "event_time": at(seconds).isoformat(),
            "machine_id": "a",
            "cluster_id": "c",
            "role": "api",
            "sequence_no": i,
            "heartbeat_ok": 1,
        }
        filled.append(made | row)
    wire = spark.createDataFrame(filled, RAW_WIRE)
    from fleetpulse.sources.files import typed_events

    return typed_events(wire)


def windows(spark, rows, bucket=30):
    """Feature windows from dicts; ``n`` is the bucket number, the rest defaults."""
    defaults = {
        f.name: 0 if f.dataType.typeName() in ("long", "integer") else 0.0
        for f in FEATURE_WINDOW.fields
    }
    filled = []
    for row in rows:
        row = dict(row)
        n = row.pop("n")
        made = defaults | {
            "machine_id": "a",
            "cluster_id": "c",
            "role": "api",
            "window_start": at(n * bucket),
            "window_end": at((n + 1) * bucket),
            "event_count": 6,
            "heartbeat_ok_mean": 1.0,
        }
        filled.append(made | row)
    return spark.createDataFrame(filled, FEATURE_WINDOW)


def incident_table(spark, starts, machine="a"):
    rows = [(machine, f"i{i}", "memory_leak", at(s)) for i, s in enumerate(starts)]
    return spark.createDataFrame(
        rows,
        "machine_id string, gt_incident_id string, gt_failure_type string, gt_failure_start_ts timestamp",
    )


def seconds(column):
    """Seconds after the base time of a timestamp column."""
    return (F.unix_seconds(column) - F.lit(int(T0.timestamp()))).alias(column)
