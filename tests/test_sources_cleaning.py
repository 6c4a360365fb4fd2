import json

import pytest
from helpers import at, events, windows

from fleetpulse.catalog import views
from fleetpulse.functions.parsing import machine_key, parse_ts, to_number
from fleetpulse.operators import cleaning, explore, metrics_frames
from fleetpulse.operators.windows import feature_windows
from fleetpulse.schemas import DECODED, METRICS_TEXT, RAW_COLUMNS, SEARCH_FEATURE_WINDOW
from fleetpulse.sources import files, topics


def metrics(spark, rows):
    """Metric text rows: (timestamp, machine, cpu), other metrics are 1."""
    return spark.createDataFrame([(t, m, c, *["1"] * 9) for t, m, c in rows], METRICS_TEXT)


def test_payload_check(spark):
    full = {c: None for c in RAW_COLUMNS} | {"event_time": "2025-03-01T00:00:00+00:00"}
    without = {k: v for k, v in full.items() if k != "role"}
    bad_time = full | {"event_time": "soon"}
    texts = [json.dumps(full), json.dumps(without), "{bad", json.dumps(bad_time), "[]"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    good, rejects = cleaning.split_valid(df)
    assert good.count() == 1
    reasons = sorted(r["reason"] for r in rejects.collect())
    assert reasons == ["malformed", "malformed", "missing: role", "unreadable event_time"]


def test_decoding_gives_typed_rows_and_nulls_for_garbage(spark):
    text = json.dumps({"event_time": "2025-03-01T00:00:30+00:00", "machine_id": "a", "cpu_pct": 1.5, "extra": 1})
    df = spark.createDataFrame([(text.encode(),), (b"{bad",)], "value binary")
    got = topics.decode_events(df).collect()
    assert got[0]["cpu_pct"] == 1.5 and got[0]["event_time"].isoformat() == "2025-03-01T00:00:30"
    assert len(got[0]) == len(DECODED.fields) == 23
    assert all(v is None for v in got[1])


def test_payloads_leave_out_nulls_and_topic_options(spark):
    df = windows(spark, [{"n": 0, "cpu_pct_mean": None}])
    row = topics.keyed_payload(df).first()
    assert row["key"] == "a" and "cpu_pct_mean" not in json.loads(row["value"])
    assert topics.decode_windows(topics.keyed_payload(df)).first()["cpu_pct_mean"] is None
    assert topics.source_options("h:1", "t") == {
        "kafka.bootstrap.servers": "h:1",
        "subscribe": "t",
        "startingOffsets": "latest",
    }


def test_window_files_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "w")
    df = feature_windows(events(spark, [{"t": 0}, {"t": 100}]))
    files.write_jsonl(df, path)
    assert files.read_feature_windows(spark, path).exceptAll(df).count() == 0
    (tmp_path / "w" / "blank.json").write_text("\n\n")
    files.write_jsonl(df, path, mode="append")
    assert files.read_feature_windows(spark, path).count() == 2 * df.count()
    text = spark.read.text(path).where("value != ''").first()[0]
    assert json.loads(text)["window_end"].endswith(("Z", "+00:00"))


def test_search_types_and_unknown_columns(spark):
    df = windows(spark, [{"n": 0}]).selectExpr("*", "'x' AS note")
    types = dict(files.conform(df, SEARCH_FEATURE_WINDOW).dtypes)
    assert types["cpu_pct_mean"] == "float" and types["error_count_sum"] == "float"
    assert types["event_count"] == "int" and types["net_rx_bytes_sum"] == "bigint"
    assert types["window_end"] == "timestamp" and types["note"] == "string"


def test_csv_by_position_and_by_name(spark, tmp_path):
    names = METRICS_TEXT.fieldNames()
    row = ",".join(["1735689600", "m1"] + ["2"] * 10)
    wrong, wide = tmp_path / "wrong.csv", tmp_path / "wide.csv"
    wrong.write_text(",".join(f"c{i}" for i in range(12)) + "\n" + row + "\n")
    wide.write_text("extra," + ",".join(names) + "\n9," + row + "\n")
    assert files.read_metrics_csv(spark, str(wrong), "position").first()["machine"] == "m1"
    assert files.read_metrics_csv(spark, str(wide), "name").columns == names
    with pytest.raises(ValueError, match="Missing"):
        files.read_metrics_csv(spark, str(wrong), "name")
    with pytest.raises(ValueError, match="Expected 12"):
        files.read_metrics_csv(spark, str(wide), "position")


@pytest.mark.parametrize(
    "text, epoch_first, day_first, expected",
    [
        ("1735689600", True, False, "2025-01-01 00:00:00"),
        ("1735689600.5", True, False, "2025-01-01 00:00:00.500000"),
        ("05-03-25 10:20:30", True, False, "2025-03-05 10:20:30"),
        ("5-3-25 1:2:3", True, False, "2025-03-05 01:02:03"),
        ("05-03-71 10:20:30", True, False, "1971-03-05 10:20:30"),
        ("05/03/2025 10:20:30", True, False, "None"),
        ("05-03-2025 10:20:30", True, False, "None"),
        ("05/03/2025 10:20:30", False, True, "2025-03-05 10:20:30"),
        ("05-03-2025 10:20", False, True, "2025-03-05 10:20:00"),
        ("05-03-25", False, True, "2025-03-05 00:00:00"),
        ("2025-03-05T10:20:30+02:00", False, True, "2025-03-05 08:20:30"),
        ("2025-03-05", False, True, "2025-03-05 00:00:00"),
        ("1735689600", False, True, "None"),
        ("41-03-25 10:20:30", True, False, "None"),
        ("n/a", True, True, "None"),
    ],
)
def test_timestamp_text(spark, text, epoch_first, day_first, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert str(df.select(parse_ts("t", day_first, epoch_first)).first()[0]) == expected


def test_numbers_and_names(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("bad",), ("NaN",), (None,), ("  ",)], "x string")
    assert [r[0] for r in df.select(to_number("x")).collect()] == [12.5, None, None, None, None]
    assert [r[0] for r in df.select(machine_key("x")).collect()] == ["12.5", "bad", "NaN", "unknown", "unknown"]


def test_medians_fill_by_machine_then_overall(spark):
    rows = [
        ("01-01-25 00:00:00", "a", "1"),
        ("01-01-25 00:00:01", "a", "3"),
        ("01-01-25 00:00:02", "a", "bad"),
        ("01-01-25 00:00:03", "b", None),
        ("01-01-25 00:00:04", "", "7"),
        ("never", "a", "9"),
    ]
    got = cleaning.explore_metrics(metrics(spark, rows)).orderBy("timestamp").collect()
    # a: median of 1 and 3; b has no value: median of 1, 3, 2 and 7.
    assert [(r["machine"], r["cpu_usage"]) for r in got] == [
        ("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 2.5), ("unknown", 7.0)
    ]


def test_clean_metrics_and_guards(spark):
    rows = [("01-01-25 00:00:00", "a", "1"), ("01-01-24 00:00:00", "a", "1"), ("01-01-25 00:00:01", None, "1"),
            ("01-01-25 00:00:02", "a", "bad")]
    assert cleaning.clean_metrics(metrics(spark, rows)).count() == 1
    typed = cleaning.typed_metrics(metrics(spark, [("never", "a", "1")]))
    with pytest.raises(ValueError):
        cleaning.require_rows(typed)
    unparsed = metrics(spark, [("never", "a", "1")]).withColumn("timestamp", parse_ts("timestamp"))
    with pytest.raises(ValueError):
        cleaning.require_rows(unparsed)


def minutes(spark, machine, n, step=60, cpu=lambda i: i):
    start = int(at(0).timestamp())
    return [(str(start + step * i), machine, str(cpu(i))) for i in range(n)]


def test_frames_skip_the_last_and_short_or_long_machines(spark):
    rows = (
        minutes(spark, "twelve", 12)
        + minutes(spark, "ten", 10)
        + minutes(spark, "long", 14, step=6 * 3600)
        + minutes(spark, "just", 12, step=6 * 3600 - 60)
    )
    clean = cleaning.clean_metrics(metrics(spark, rows))
    frames = metrics_frames.metric_sequences(clean)
    found = {r["machine"]: r["count"] for r in frames.groupBy("machine").count().collect()}
    assert found == {"twelve": 2, "just": 2}
    first = frames.where("machine = 'twelve'").orderBy("start").first()
    assert len(first["features"]) == 10 and first["features"][0][0] == 0.0
    assert first["features"][9][0] == pytest.approx(9 / 11)


def test_positional_split_rounds_the_test_part_up(spark):
    clean = cleaning.clean_metrics(metrics(spark, minutes(spark, "a", 15) + minutes(spark, "b", 16)))
    split = metrics_frames.positional_split(metrics_frames.metric_sequences(clean))
    got = split.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(11))
    assert [r["machine"] for r in got] == ["a"] * 5 + ["b"] * 6
    assert [r["split"] for r in got] == ["train"] * 8 + ["test"] * 3


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    got = explore.histogram(df, "x", bins=3).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 2, 0]
    assert [round(r["lower"], 2) for r in got] == [4.5, 4.83, 5.17]
    assert got[-1]["upper"] == pytest.approx(5.5)


def test_correlation_of_a_constant_is_absent(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    got = {(r["x"], r["y"]): r["r"] for r in explore.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("b", "a")] == pytest.approx(1.0)
    assert got[("a", "c")] is None and got[("c", "c")] is None and len(got) == 9


def test_views_use_every_event(spark, sf_dir):
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for view in (views.telemetry, views.metrics_text, views.scores):
        assert view(spark, sf_dir).count() == total
