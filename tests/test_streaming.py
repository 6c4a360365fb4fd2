import json
from collections import Counter
from dataclasses import replace

import pytest
from helpers import at, events, windows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from fleetpulse.catalog import views
from fleetpulse.config import MODEL_COLUMNS, Settings
from fleetpulse.operators.scoring import score_batch
from fleetpulse.operators.windows import feature_windows
from fleetpulse.plans.training import build_training_frame, read_manifest, score_windows, train_and_save
from fleetpulse.schemas import FEATURE_WINDOW, PREDICTION, RAW_COLUMNS
from fleetpulse.sources import topics
from fleetpulse.streaming.jobs import (
    archive_stream,
    capture_history,
    load_predictions,
    start_feature_job,
    start_scoring_job,
)
from fleetpulse.streaming.lookback import lookback_frames, score_frames_with, upsert


def feed(df, path, n):
    """Write a frame as input file number ``n`` of a stream."""
    df.coalesce(1).write.parquet(f"{path}/{n:02d}")


def source(spark, path, schema):
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.option("recursiveFileLookup", True).parquet(path)


def run_to_end(stream, out, partition=None, time="window_end"):
    query = archive_stream(stream, f"{out}/data", f"{out}/cp", partition, time, fmt="parquet", once=True)
    query.awaitTermination()
    return query, stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def test_upsert_replaces_in_place_and_evicts_the_oldest_arrival():
    row = lambda end, tag=0: (end - 30, end, tag)
    buffer = []
    for end in (90, 30, 60):
        buffer = upsert(buffer, row(end), 3)
    assert [r[1] for r in upsert(buffer, row(30, 1), 3)] == [90, 30, 60]
    assert upsert(buffer, row(30, 1), 3)[1] == row(30, 1)
    assert [r[1] for r in upsert(buffer, row(10), 3)] == [30, 60, 10]


def test_online_buffer(spark, tmp_path):
    cpu = lambda i: {"n": i, "cpu_pct_mean": float(i)}
    inputs = str(tmp_path / "in")
    feed(windows(spark, [cpu(i) for i in range(1, 20)]), inputs, 0)
    feed(windows(spark, [cpu(20)]), inputs, 1)
    feed(windows(spark, [{"n": 5, "cpu_pct_mean": 99.0, "role": "db"}]), inputs, 2)
    feed(windows(spark, [cpu(0)]), inputs, 3)
    frames = lookback_frames(source(spark, inputs, FEATURE_WINDOW), 20)
    _, got = run_to_end(frames, str(tmp_path / "out"))
    rows = sorted(got.collect(), key=lambda r: (r["role"], r["features"][0][0]))
    assert len(rows) == 3
    # The 20th window completes the buffer; the repeat of window 5 replaces it and keeps
    # its own identity; the late window 0 drops the first arrival and sorts first.
    late, complete, repeat = rows
    assert [f[0] for f in complete["features"]] == [float(i) for i in range(1, 21)]
    assert repeat["role"] == "db" and repeat["features"][4][0] == 99.0
    assert late["features"][0][0] == 0.0 and late["features"][1][0] == 2.0
    assert {r["window_end"] for r in rows} == {at(21 * 30).replace(tzinfo=None)}
    assert complete["features"][0][MODEL_COLUMNS.index("cpu_delta")] == 0.0
    assert complete["cpu_delta"] == 1.0


def mean_score(frames):
    return frames.withColumn("score", F.aggregate("features", F.lit(0.0), lambda a, r: a + r[0]) / 2000)


def test_online_records_equal_batch_records(spark, tmp_path):
    table = windows(spark, [{"n": 2 * i, "cpu_pct_mean": float(7 * i % 90), "mem_pct_mean": 90.0 + i} for i in range(40)])
    inputs = str(tmp_path / "in")
    for k in range(4):
        feed(table.where(F.col("cpu_pct_mean") >= 0).orderBy("window_end").offset(10 * k).limit(10), inputs, k)
    stream = score_frames_with(lookback_frames(source(spark, inputs, FEATURE_WINDOW), 20), mean_score, 0.2, "v")
    _, got = run_to_end(stream, str(tmp_path / "out"))
    batch = score_batch(table, mean_score, 0.2, "v")
    assert got.columns == PREDICTION.fieldNames() and batch.count() == 21
    assert got.drop("@timestamp").exceptAll(batch.drop("@timestamp")).count() == 0
    assert got.count() == 21


def test_final_windows_and_bounded_deduplication_state(spark, tmp_path):
    inputs = str(tmp_path / "in")
    for k in range(4):
        batch = [{"t": 30 * i, "sequence_no": i} for i in range(10 * k, 10 * k + 10)]
        feed(events(spark, batch + batch), inputs, k)
    schema = spark.read.parquet(f"{inputs}/00").schema
    seen = []

    def publish(df, checkpoint, name):
        def keep(part, _):
            seen.extend(r["window_start"] for r in part.collect())

        writer = df.writeStream.outputMode("update").foreachBatch(keep).queryName(name)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    queries = start_feature_job(
        source(spark, inputs, schema), publish, str(tmp_path / "finals"), str(tmp_path / "cp"), Settings(), once=True
    )
    for query in queries:
        query.awaitTermination()
    finals = spark.read.schema(FEATURE_WINDOW).json(str(tmp_path / "finals"))
    assert finals.count() == 35 and finals.where("event_count = 1").count() == 35
    assert len(set(seen)) == 40
    states = [p["stateOperators"][-1]["numRowsTotal"] for p in (json.loads(p.json) if hasattr(p, "json") and not callable(p.json) else p for p in queries[1].recentProgress)]
    assert max(states) <= 25
    batch = feature_windows(events(spark, [{"t": 30 * i, "sequence_no": i} for i in range(40)]), mode="stream")
    assert finals.select(*FEATURE_WINDOW.fieldNames()).exceptAll(batch).count() == 0


def test_capture_keeps_text_and_sets_rejects_aside(spark, tmp_path):
    full = {c: None for c in RAW_COLUMNS} | {"event_time": "2025-03-01T00:00:00+00:00", "machine_id": "a"}
    inputs = tmp_path / "in"
    inputs.mkdir()
    (inputs / "a.txt").write_text(json.dumps(full) + "\n{bad\n" + json.dumps({"role": "x"}) + "\n")
    raw = spark.readStream.text(str(inputs))
    for query in capture_history(raw, str(tmp_path / "ok"), str(tmp_path / "dlq"), str(tmp_path / "cp"), once=True):
        query.awaitTermination()
    kept = spark.read.text(str(tmp_path / "ok")).collect()
    assert [json.loads(r["value"])["machine_id"] for r in kept] == ["a"]
    assert (tmp_path / "ok" / "dt=2025-03-01").exists()
    assert spark.read.json(str(tmp_path / "dlq")).count() == 2


def test_prediction_table_is_typed_and_dated(spark, tmp_path):
    from fleetpulse.sources.files import write_jsonl

    table = windows(spark, [{"n": i} for i in range(21)])
    write_jsonl(score_batch(table, mean_score, 0.2, "v"), str(tmp_path / "in"), mode="append")
    load_predictions(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp"), once=True).awaitTermination()
    loaded = spark.read.parquet(str(tmp_path / "t"))
    assert loaded.count() == 2 and dict(loaded.dtypes)["p_fail_5m"] == "float" and "dt" in loaded.columns


def test_training_and_stored_model_scoring(spark, sf_dir, tmp_path):
    settings = replace(views.SETTINGS, rounds=2, depth=2)
    raw = views.telemetry(spark, sf_dir)
    model_dir = str(tmp_path / "model")
    made = train_and_save(raw, model_dir, settings)
    stored = read_manifest(spark, model_dir)
    assert stored["threshold"] == made["threshold"] and stored["feature_columns"] == MODEL_COLUMNS
    assert 0.0 <= stored["test_metrics"]["roc_auc"] <= 1.0 and stored["train_sequences"] > 0
    table = feature_windows(raw, settings.bucket_seconds, settings.tick_seconds, mode="stream")
    inputs = str(tmp_path / "in")
    feed(table, inputs, 0)
    batch = score_windows(spark.read.schema(FEATURE_WINDOW).parquet(f"{inputs}/00"), model_dir)
    out = str(tmp_path / "out")
    windows_in = source(spark, inputs, FEATURE_WINDOW)
    for query in start_scoring_job(windows_in, model_dir, None, out, str(tmp_path / "cp"), once=True):
        query.awaitTermination()
    # Read back, the files also have the date they are partitioned by.
    online = spark.read.schema(PREDICTION).json(out).drop("dt")
    assert batch.count() > 0
    assert online.count() == batch.count()
    assert online.drop("@timestamp").exceptAll(batch.drop("@timestamp")).count() == 0


def test_training_needs_enough_history(spark, tmp_path):
    with pytest.raises(ValueError, match="Not enough history"):
        train_and_save(events(spark, [{"t": 0}]), str(tmp_path / "m"))


def test_training_frame_equals_its_parts(spark):
    raw = events(spark, [{"t": 20 * i, "cpu_pct": float(i % 7), "machine_id": f"m{i % 2}"} for i in range(300)])
    from fleetpulse.operators.cleaning import incidents
    from fleetpulse.operators.derived import add_derived
    from fleetpulse.operators.labels import label_windows

    joined = build_training_frame(raw)
    parts = label_windows(add_derived(feature_windows(raw), 30), incidents(raw))
    assert joined.exceptAll(parts).count() == 0 and joined.count() == parts.count()


STREAMED = ["a4_archived_events", "g2_final_windows", "g3_streamed_events", "g6_online_predictions"]


@pytest.mark.parametrize("name", STREAMED)
def test_streams_read_every_part_of_a_table(spark, sf_dir, tmp_path, name):
    query = contract.queries()[name]
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    parts = Counter(map(tuple, query(spark, str(tmp_path)).collect()))
    assert parts and parts == Counter(map(tuple, query(spark, sf_dir).collect()))


def test_a_repeated_window_fills_one_place(spark):
    table = windows(spark, [{"n": i} for i in range(1, 20)] + [{"n": 5, "role": "db"}])
    assert score_batch(table, mean_score, 0.2, "v").count() == 0
    full = table.union(windows(spark, [{"n": 20}]))
    assert score_batch(full, mean_score, 0.2, "v").count() == 1


def test_unreadable_windows_reach_the_rejects_and_no_buffer(spark):
    good = topics.keyed_payload(windows(spark, [{"n": i} for i in range(3)])).select("value")
    bad = spark.createDataFrame([("{not json",)] * 25 + [('{"role": "db"}',), (None,)], "value string")
    every = good.union(bad)
    assert topics.decode_windows(every).count() == 3
    rejects = topics.rejected_windows(every)
    assert rejects.count() == 27 and rejects.columns == ["reason", "value"]
