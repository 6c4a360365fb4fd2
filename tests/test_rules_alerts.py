import random

import pytest
from helpers import at

from fleetpulse.functions.rules import FAILURE_RULES, failure_mode_col, gauge_band_col, risk_band_col
from fleetpulse.operators import alerts, dashboards
from fleetpulse.operators.cleaning import latest_by_key
from fleetpulse.operators.evaluation import best_threshold, evaluate, pr_curve


def test_risk_bands(spark):
    df = spark.createDataFrame([(x,) for x in (1.02, 1.0, 0.9, 0.63, 0.62)], "s double")
    got = [r[0] for r in df.select(risk_band_col("s", 0.9)).collect()]
    assert got == ["critical", "high", "high", "medium", "low"]


def test_gauge_bands_use_their_own_breaks(spark):
    df = spark.createDataFrame([(x,) for x in (0.8, 0.79, 0.35, 0.25, 0.2)], "s double")
    got = [r[0] for r in df.select(gauge_band_col("s")).collect()]
    assert got == ["critical", "high", "high", "medium", "low"]


MEASURES = sorted({m for _, above, below in FAILURE_RULES for m in [*above, *below]})


@pytest.mark.parametrize(
    "measures, mode",
    [
        ({"mem_pct_mean": 90, "mem_delta": 1}, "memory_leak"),
        ({"mem_pct_mean": 90, "mem_delta": 0}, "unknown"),
        ({"mem_pct_mean": float("nan"), "mem_delta": 1}, "unknown"),
        ({"cpu_pct_mean": 89, "queue_depth_mean": 31, "net_retransmit_pct_mean": 9}, "cpu_saturation"),
        ({"net_retransmit_pct_mean": 4.1}, "network_meltdown"),
        ({"disk_used_pct_mean": 93, "disk_io_wait_pct_mean": 36}, "disk_exhaustion"),
        ({"gpu_mem_pct_mean": 91, "gpu_util_pct_mean": 10}, "gpu_oom"),
        ({"gpu_mem_pct_mean": 91, "gpu_util_pct_mean": None}, "gpu_oom"),
        ({"heartbeat_drop_ratio": 0.4, "error_count_sum": 11}, "app_crash"),
        ({}, "unknown"),
    ],
)
def test_failure_modes(spark, measures, mode):
    row = [0.0 if m not in measures else measures[m] for m in MEASURES]
    row = [None if v is None else float(v) for v in row]
    df = spark.createDataFrame([row], ", ".join(f"{m} double" for m in MEASURES))
    assert df.select(failure_mode_col()).first()[0] == mode


def confirmed_at(spark, seconds):
    return spark.createDataFrame([("m", at(s)) for s in seconds], "machine_id string, eval_at timestamp")


def fired(df):
    rows = df.where("fired").orderBy("eval_at").collect()
    return [int((r["eval_at"].timestamp())) for r in rows]


def test_suppression(spark):
    df = confirmed_at(spark, [0, 100, 600, 700, 1200])
    base = int(at(0).timestamp())
    assert [t - base for t in fired(alerts.suppress(df, 10))] == [0, 600, 1200]


@pytest.mark.parametrize("span", [600, 1000, 86400])
def test_suppression_over_slices_matches_a_scan(spark, span):
    rng = random.Random(span)
    times = sorted({rng.randrange(40000) for _ in range(700)} | {90000, 90300, 400000})
    expected, last = [], None
    for t in times:
        if last is None or t >= last + 600:
            expected.append(t)
            last = t
    base = int(at(0).timestamp())
    got = [t - base for t in fired(alerts.suppress(confirmed_at(spark, times), 10, span=span))]
    assert got == expected


def evaluations(spark, marks):
    """One evaluation a minute: x breached, . below, blank none."""
    rows = [("m", at(60 * i), c == "x") for i, c in enumerate(marks) if c != " "]
    return spark.createDataFrame(rows, "machine_id string, eval_at timestamp, breached boolean")


def marked(df, column, n):
    hits = {int((r["eval_at"] - at(0).replace(tzinfo=None)).total_seconds()) // 60 for r in df.where(column).collect()}
    return "".join("^" if i in hits else "." for i in range(n))


def test_confirmation_and_recovery(spark):
    marks = "x.xx...xx. ...  x x...."
    confirmed = alerts.confirm(evaluations(spark, marks))
    assert marked(confirmed, "confirmed", len(marks)) == "...^....^.............."
    recovered = alerts.recover(confirmed)
    assert marked(recovered, "recovered", len(marks)) == "......^......^........."


def test_evaluation_takes_the_highest_score_of_the_window(spark):
    rows = [("m", at(10), 0.5), ("m", at(70), 0.9), ("m", at(190), 0.8)]
    df = spark.createDataFrame(rows, "machine_id string, window_end timestamp, p_fail_5m double")
    got = alerts.evaluate_alerts(df).orderBy("eval_at").collect()
    assert [r["max_score"] for r in got] == [0.5, 0.9, 0.9, 0.8, 0.8]
    assert [r["breached"] for r in got] == [False, True, True, False, False]


def test_newest_prediction_and_upsert(spark):
    rows = [("m", at(1), 1, 0.2), ("m", at(9), 2, 0.4), ("m", at(9), 3, 0.3)]
    df = spark.createDataFrame(rows, "machine_id string, window_end timestamp, arrival int, p_fail_5m double")
    assert {(r["arrival"]) for r in latest_by_key(df).collect()} == {1, 3}
    assert dashboards.fleet_risk(latest_by_key(df)).first()["p_fail_5m"] == 0.3


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_thresholds_and_metrics(spark):
    df = scored(spark, [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)])
    curve = {r["score"]: (r["precision"], r["recall"]) for r in pr_curve(df).collect()}
    assert curve == {0.1: (0.5, 1.0), 0.35: (2 / 3, 1.0), 0.4: (0.5, 0.5), 0.8: (1.0, 0.5)}
    assert best_threshold(df).first()["threshold"] == 0.35
    got = evaluate(df, 0.35).first()
    assert got["roc_auc"] == 0.75
    assert got["pr_auc"] == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)
    assert (got["precision"], got["recall"]) == (2 / 3, 1.0)
    assert got["f1"] == pytest.approx(0.8)


def test_metrics_without_positives_or_rows(spark):
    negatives = scored(spark, [(0, 0.2), (0, 0.4)])
    assert tuple(evaluate(negatives, 0.3).first()) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert best_threshold(negatives).first()["threshold"] == 0.2
    assert best_threshold(scored(spark, [])).first()["threshold"] == 0.5


def test_metrics_match_pair_counting(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(2), rng.randrange(30) / 30) for _ in range(400)]
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate(scored(spark, pairs), 0.5).first()["roc_auc"] == pytest.approx(auc)


def test_band_matrix_and_warning(spark):
    rows = [("m", 0.99, 0.1), ("m", 0.7, 0.9), ("n", 0.1, -0.5), ("n", 0.7, -0.5)]
    df = spark.createDataFrame(rows, "machine_id string, p_fail_5m double, missing_ratio double").withColumn(
        "risk_band", risk_band_col("p_fail_5m", 0.6)
    )
    assert dashboards.early_warning(df).count() == 1
    matrix = {r["machine_id"]: tuple(r[1:]) for r in dashboards.machine_band_matrix(df).collect()}
    assert matrix == {"m": (0, 0, 1, 1), "n": (1, 0, 1, 0)}
