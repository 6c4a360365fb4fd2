import pytest
from helpers import events, seconds, windows
from pyspark.sql import functions as F

from fleetpulse.functions.parsing import expected_rows_per_bucket
from fleetpulse.operators.cleaning import dedupe_events
from fleetpulse.operators.derived import add_derived
from fleetpulse.operators.windows import feature_windows, machine_identity


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("machine_id", "window_start").select(*columns).collect()]


def test_empty_buckets_are_filled_twice_then_zero(spark):
    df = events(spark, [{"t": 1, "cpu_pct": 7.0, "net_rx_bytes": 5}, {"t": 151, "cpu_pct": 9.0}])
    got = rows(
        feature_windows(df), seconds("window_start"), "cpu_pct_mean", "net_rx_bytes_sum", "event_count", "missing_ratio"
    )
    assert [r[0] for r in got] == [0, 30, 60, 90, 120, 150]
    assert [r[1] for r in got] == [7.0, 7.0, 7.0, 0.0, 0.0, 9.0]
    assert [r[2] for r in got] == [5, 0, 0, 0, 0, 0]
    assert [r[3] for r in got] == [1, 0, 0, 0, 0, 1]
    assert got[1][4] == 1.0


def test_fill_and_differences_cross_slice_borders(spark):
    # Over 4096 buckets of 30 s: several slices of one machine.
    df = events(spark, [{"t": 30 * i + 1, "cpu_pct": float(i % 50)} for i in range(0, 9000, 3)])
    dense = feature_windows(df)
    got = rows(add_derived(dense, 30), "cpu_pct_mean", "cpu_delta")
    expected = [float((i - i % 3) % 50) for i in range(len(got))]
    assert [r[0] for r in got] == expected
    assert [r[1] for r in got] == [0.0] + [b - a for a, b in zip(expected, expected[1:])]
    by_position = rows(add_derived(dense), "cpu_pct_mean", "cpu_delta")
    assert by_position == got


def test_missing_ratio_clips_only_in_batch(spark):
    df = events(spark, [{"t": i} for i in range(7)])
    assert rows(feature_windows(df), "missing_ratio") == [(0.0,)]
    assert rows(feature_windows(df, mode="stream"), "missing_ratio") == [((6 - 7) / 6,)]


def test_expected_rows_round_half_to_even():
    assert expected_rows_per_bucket(12, 30) == 2
    assert expected_rows_per_bucket(5, 30) == 6
    assert expected_rows_per_bucket(100, 30) == 1


def test_batch_counts_sequence_numbers_and_stream_counts_rows(spark):
    df = events(spark, [{"t": 0}, {"t": 1, "sequence_no": None}])
    assert rows(feature_windows(df), "event_count") == [(1,)]
    assert rows(feature_windows(df, mode="stream"), "event_count") == [(2,)]


def test_identity_is_that_of_the_earliest_event(spark):
    df = events(spark, [{"t": 50, "role": "db"}, {"t": 10, "role": "web"}, {"t": 90, "role": "db"}])
    assert machine_identity(df).select("role").collect()[0][0] == "web"
    assert {r[0] for r in rows(feature_windows(df), "role")} == {"web"}
    assert {r[0] for r in rows(feature_windows(df, mode="stream"), "role")} == {"web", "db"}


def test_events_without_machine_or_time_are_left_out(spark):
    df = events(spark, [{"t": 0}, {"t": 1, "machine_id": None}, {"t": 2, "event_time": "soon"}])
    assert rows(feature_windows(df), "machine_id", "event_count") == [("a", 1)]


def test_bucket_must_divide_a_day(spark):
    with pytest.raises(ValueError):
        feature_windows(events(spark, [{"t": 0}]), bucket=7)
    with pytest.raises(ValueError):
        feature_windows(events(spark, [{"t": 0}]), mode="other")


def test_repeats_are_removed(spark):
    df = events(spark, [{"t": 0, "sequence_no": 1}, {"t": 0, "sequence_no": 1}, {"t": 3, "sequence_no": 2}])
    assert dedupe_events(df).count() == 2
    assert rows(feature_windows(df, mode="stream"), "event_count") == [(2,)]
    assert rows(feature_windows(df, dedupe=True), "event_count") == [(2,)]
    assert rows(feature_windows(df), "event_count") == [(3,)]


def test_a_nan_reading_is_absent(spark):
    df = events(spark, [{"t": 0, "mem_pct": float("nan")}, {"t": 1, "mem_pct": 4.0}])
    assert rows(feature_windows(df), "mem_pct_mean", "mem_pct_max") == [(4.0, 4.0)]


def test_derived_columns(spark):
    df = windows(
        spark,
        [
            {"n": 0, "request_rate_mean": 0.5, "error_count_sum": 3, "net_rx_bytes_sum": 2, "net_tx_bytes_sum": 3},
            {"n": 1, "request_rate_mean": 4.0, "error_count_sum": 2, "heartbeat_ok_mean": 0.25, "queue_depth_mean": 6.0},
        ],
    )
    got = rows(add_derived(df, 30), "error_rate", "throughput_total", "heartbeat_drop_ratio", "queue_delta")
    assert got == [(3.0, 5.0, 0.0, 0.0), (0.5, 0.0, 0.75, 6.0)]


def test_raw_scan_prunes_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "raw")
    events(spark, [{"t": i} for i in range(20)]).write.parquet(path)
    plan = machine_identity(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "IsNotNull(machine_id)" in scan and "IsNotNull(event_time)" in scan
    assert "cpu_pct" not in scan
    assert "SortAggregate" not in plan.split("Exchange")[-1]


def test_seven_buckets_agree_with_a_plain_aggregate(spark):
    df = events(spark, [{"t": 5 * i, "machine_id": f"m{i % 3}", "cpu_pct": float(i)} for i in range(42)])
    plain = df.groupBy("machine_id", F.window("event_time", "30 seconds")).agg(F.avg("cpu_pct").alias("x"))
    expected = sorted((r["machine_id"], r["window"]["start"], r["x"]) for r in plain.collect())
    assert sorted(rows(feature_windows(df), "machine_id", "window_start", "cpu_pct_mean")) == expected
