import random

import pytest
from helpers import at, incident_table, windows
from pyspark.sql import functions as F

from fleetpulse.config import MODEL_COLUMNS
from fleetpulse.operators.derived import add_derived
from fleetpulse.operators.labels import label_windows
from fleetpulse.operators.ordered import carry_last, exact_quantiles, running_sums, with_position
from fleetpulse.operators.sequences import scoring_frames, sequences
from fleetpulse.operators.splitting import (
    apply_minmax,
    class_balance,
    fit_minmax,
    require_splits,
    split_by_time,
    time_cutoffs,
)


def labels(df):
    picked = df.orderBy("machine_id", "window_end").select(
        "target_failure_within_horizon", "lead_time_sec", "eligible_for_training"
    )
    return [tuple(r) for r in picked.collect()]


def test_failure_at_window_end_is_too_early_and_at_the_horizon_counts(spark):
    one = windows(spark, [{"n": 0}])
    assert labels(label_windows(one, incident_table(spark, [30])))[0][:2] == (0, None)
    assert labels(label_windows(one, incident_table(spark, [330])))[0][:2] == (1, 300.0)
    assert labels(label_windows(one, incident_table(spark, [331])))[0][:2] == (0, None)
    assert labels(label_windows(one, incident_table(spark, [30, 60])))[0][:2] == (1, 30.0)
    assert labels(label_windows(one, incident_table(spark, [60], machine="b")))[0][:2] == (0, None)


def test_eligibility(spark):
    df = windows(
        spark,
        [
            {"n": 0, "gt_phase_code_max": 2},
            {"n": 1, "gt_phase_code_max": 4},
            {"n": 2, "gt_phase_code_max": 1, "gt_is_failure_now_max": 1},
        ],
    )
    assert [r[2] for r in labels(label_windows(df, incident_table(spark, [])))] == [True, False, False]


@pytest.mark.parametrize("horizon", [5, 90, 3000])
def test_labels_match_a_search_over_all_failures(spark, horizon):
    rng = random.Random(horizon)
    places = sorted(rng.sample(range(12000), 300))
    starts = sorted(rng.sample(range(0, 360000), 40)) + [30 * (places[5] + 1)]
    df = windows(spark, [{"n": n} for n in places])
    got = labels(label_windows(df, incident_table(spark, starts), horizon))
    for n, (label, lead, _) in zip(places, got):
        later = [s - 30 * (n + 1) for s in starts if s > 30 * (n + 1)]
        within = [x for x in later if x <= horizon * 60]
        assert (label, lead) == ((1, float(min(within))) if within else (0, None))


def test_positions_and_running_sums_of_a_dominant_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", at(rng.randrange(10**7)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "machine_id string, window_end timestamp, i long")
    df = df.dropDuplicates(["machine_id", "window_end"])
    placed = with_position(df, ["machine_id"], "window_end").collect()
    by_key = {}
    for r in sorted(placed, key=lambda r: (r["machine_id"], r["window_end"])):
        by_key[r["machine_id"]] = by_key.get(r["machine_id"], 0) + 1
        assert r["_position"] == by_key[r["machine_id"]]
    summed = running_sums(df, ["machine_id"], ["window_end"], ["i"]).collect()
    totals = {}
    for r in sorted(summed, key=lambda r: (r["machine_id"], r["window_end"])):
        totals[r["machine_id"]] = totals.get(r["machine_id"], 0) + r["i"]
        assert r["cum_i"] == totals[r["machine_id"]]
    assert all(r["total_i"] == totals[r["machine_id"]] for r in summed)


def test_quantiles_match_pandas(spark):
    rng = random.Random(11)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.choice([None, rng.gauss(0, 9), float(i % 4)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.7, "d": 0.99, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "x", probs).collect()}
    groups = df.toPandas().dropna().groupby("k")["x"]
    for key, values in groups:
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(values.quantile(p), abs=1e-12)
    whole = exact_quantiles(df, [], "x", probs).first()
    assert whole["c"] == pytest.approx(df.toPandas()["x"].quantile(0.7), abs=1e-12)


def test_carried_value_is_the_latest_before(spark):
    rng = random.Random(5)
    rows = [("m", at(i * 5000), rng.choice([None, None, 0, 1])) for i in range(400)]
    df = spark.createDataFrame(rows, "machine_id string, eval_at timestamp, v int")
    got = carry_last(df, ["machine_id"], "eval_at", "v", "before").orderBy("eval_at").collect()
    last = None
    for row, (_, _, value) in zip(got, rows):
        assert row["before"] == last
        last = value if value is not None else last


def test_scaler_keeps_constants_at_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    params = fit_minmax(df, ["x", "c"])
    assert {r["feature"]: (r["scale"], r["min"]) for r in params.collect()} == {"x": (0.5, -0.5), "c": (1.0, -5.0)}
    beyond = spark.createDataFrame([(5.0, 6.0)], "x double, c double")
    for saved in (False, True):
        assert tuple(apply_minmax(beyond, params, ["x", "c"], saved).first()) == (2.0, 1.0)


def prepared_rows(spark, n, **extra):
    rows = label_windows(windows(spark, [{"n": i} | extra for i in range(n)]), incident_table(spark, []))
    return add_derived(rows, 30)


def test_sequences_do_not_cross_splits(spark):
    df = prepared_rows(spark, 25)
    split = df.withColumn("split", F.when(F.col("window_end") <= F.lit(at(600)), "train").otherwise("validation"))
    for bucket in (30, None):
        built = sequences(split, bucket=bucket)
        assert [r["split"] for r in built.collect()] == ["train"]
    first = sequences(split, bucket=30).first()
    assert len(first["features"]) == 20 and len(first["features"][0]) == len(MODEL_COLUMNS)


def test_sequences_end_at_eligible_rows_and_need_complete_frames(spark):
    df = prepared_rows(spark, 22).withColumn("split", F.lit("train"))
    odd = df.withColumn("eligible_for_training", F.col("window_end") != F.lit(at(600)))
    # The ineligible row ends no sequence, yet may lie inside later frames.
    assert sequences(odd, bucket=30).count() == 2
    sparse = df.withColumn("missing_ratio", F.lit(0.85)).withColumn("missing_ratio_raw", F.lit(0.1))
    assert sequences(sparse, bucket=30).count() == 0
    assert sequences(sparse, bucket=30, missing_on="raw").count() == 3


def test_sequences_across_slices_hold_the_previous_rows(spark):
    df = prepared_rows(spark, 9000).withColumn("split", F.lit("train"))
    df = df.withColumn("cpu_pct_mean", (F.unix_seconds("window_end") / 30 % 5000).cast("double"))
    built = sequences(df, bucket=30)
    assert built.count() == 9000 - 19
    checked = built.select(
        F.transform("features", lambda r: r[0]).alias("f"), (F.unix_seconds("window_end") / 30).alias("g")
    )
    wrong = checked.where(
        ~F.forall(
            F.sequence(F.lit(0), F.lit(19)),
            lambda i: F.col("f")[i] == ((F.col("g") - 19 + i) % 5000).cast("float"),
        )
    )
    assert wrong.count() == 0


def test_scoring_frames_restart_differences(spark):
    df = windows(spark, [{"n": 3 * i, "cpu_pct_mean": float(i * i)} for i in range(22)])
    frames = scoring_frames(df, 20).orderBy("window_end").collect()
    delta = MODEL_COLUMNS.index("cpu_delta")
    assert len(frames) == 3
    assert frames[1]["features"][0][delta] == 0.0
    assert frames[1]["features"][1][delta] == float(2 * 2 - 1)


def test_split_cutoffs_interpolate(spark):
    df = windows(spark, [{"n": i} for i in range(10)])
    cut = time_cutoffs(df).first()
    ends = [at(30 * (i + 1)).timestamp() * 1e6 for i in range(10)]
    assert cut["train_cutoff"] == pytest.approx(ends[6] + 0.3 * (ends[7] - ends[6]), abs=1)
    sizes = {r["split"]: r["count"] for r in split_by_time(df).groupBy("split").count().collect()}
    assert sizes == {"train": 7, "validation": 1, "test": 2}
    with pytest.raises(ValueError):
        require_splits(split_by_time(windows(spark, [{"n": 0}])))


def test_class_balance_is_bounded(spark):
    def weight(labels):
        df = spark.createDataFrame([(x,) for x in labels], "label int")
        return class_balance(df).first()["positive_weight"]

    assert weight([1] + [0] * 4) == 4.0
    assert weight([1] + [0] * 90) == 20.0
    assert weight([1, 1, 0]) == 1.0
    assert weight([0, 0, 0]) == 3.0
