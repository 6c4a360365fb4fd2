"""Checked queries over scores: evaluation, prediction records, dashboards, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.catalog import expressions as _expressions  # noqa: F401  (registers the SQL)
from fleetpulse.catalog.registry import CTES, query
from fleetpulse.catalog.telemetry_queries import KEY, stream_shaped_windows
from fleetpulse.catalog.views import (
    ALERT_SLIDE,
    ALERT_SLIDE_SECONDS,
    ALERT_WINDOW,
    QUIET_MINUTES,
    SETTINGS,
    scores,
)
from fleetpulse.functions.parsing import bucket_start
from fleetpulse.functions.rules import (
    FAILURE_RULES,
    alert_col,
    failure_mode_col,
    gauge_band_col,
    risk_band_col,
)
from fleetpulse.operators import alerts, dashboards, evaluation
from fleetpulse.operators.cleaning import latest_by_key
from fleetpulse.operators.derived import add_derived
from fleetpulse.operators.scoring import score_batch
from fleetpulse.schemas import SEARCH_PREDICTION
from fleetpulse.session import stage
from fleetpulse.sources.files import conform

THRESHOLD = 0.6
BATCH_THRESHOLD = 0.35


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("risk_band", risk_band_col("p_fail_5m", THRESHOLD))


# ---- evaluation of scores


@query("d25_pr_curve", "score:4 precision:6 recall:6 f1:6", "pr_points")
def _(spark, sf_dir):
    return evaluation.pr_curve(scores(spark, sf_dir), score="p_fail_5m")


@query("d25_best_threshold", "threshold:4 f1:6",
       "SELECT score AS threshold, f1 FROM pr_points ORDER BY f1 DESC, score LIMIT 1")
def _(spark, sf_dir):
    return evaluation.best_threshold(scores(spark, sf_dir), score="p_fail_5m")


_AT = f"score >= {THRESHOLD}e0"


@query(
    "d26_evaluation",
    "roc_auc:6 pr_auc:6 precision:6 recall:6 f1:6",
    f"""SELECT (SELECT sum(CAST(a.pos AS DOUBLE) * (CASE WHEN b.score < a.score THEN 1e0 WHEN b.score = a.score THEN 0.5e0
          ELSE 0e0 END) * (b.n - b.pos)) FROM score_points a, score_points b) / (max(total_pos) * (max(total_n) - max(total_pos))) AS roc_auc,
        sum(pos * (pos_above / n_above)) / max(total_pos) AS pr_auc,
        sum(pos) FILTER ({_AT}) / sum(n) FILTER ({_AT}) AS precision, sum(pos) FILTER ({_AT}) / max(total_pos) AS recall,
        2 * sum(pos) FILTER ({_AT}) / (sum(n) FILTER ({_AT}) + max(total_pos)) AS f1 FROM score_curve""",
)
def _(spark, sf_dir):
    return evaluation.evaluate(scores(spark, sf_dir), THRESHOLD, score="p_fail_5m")


# ---- rules

_MODE_SQL = "CASE " + " ".join(
    "WHEN "
    + " AND ".join(
        [f"coalesce({m}, 0) > {bound}" for m, bound in above.items()]
        + [f"coalesce({m}, 0) < {bound}" for m, bound in below.items()]
    )
    + f" THEN '{mode}'"
    for mode, above, below in FAILURE_RULES
) + " ELSE 'unknown' END"


@query(
    "b18_failure_mode",
    f"{KEY} mode",
    f"""SELECT *, {_MODE_SQL} AS mode FROM (SELECT *, 1e0 - heartbeat_ok_mean AS heartbeat_drop_ratio,
          coalesce(mem_pct_mean - lag(mem_pct_mean) OVER (PARTITION BY machine_id ORDER BY window_end), 0e0) AS mem_delta
        FROM stream_windows)""",
)
def _(spark, sf_dir):
    return add_derived(stream_shaped_windows(spark, sf_dir)).withColumn("mode", failure_mode_col())


@query("b19_risk_band", "seq p_fail_5m:4 risk_band", "predictions")
def _(spark, sf_dir):
    return predictions(spark, sf_dir)


@query("b20_alert_flag", "seq alert_fired:i", f"SELECT *, p_fail_5m >= {THRESHOLD}e0 AS alert_fired FROM scores")
def _(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("alert_fired", alert_col("p_fail_5m", THRESHOLD))


_GAUGE_SQL = """CASE WHEN p_fail_5m >= 0.8e0 THEN 'critical' WHEN p_fail_5m >= 0.35e0 THEN 'high'
  WHEN p_fail_5m >= 0.25e0 THEN 'medium' ELSE 'low' END"""


@query("b23_gauge_band", "seq gauge_band", f"SELECT *, {_GAUGE_SQL} AS gauge_band FROM scores")
def _(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("gauge_band", gauge_band_col("p_fail_5m"))


# ---- scoring a window table with a score that SQL can compute


def _mean_cpu_score(frames: DataFrame) -> DataFrame:
    total = F.aggregate("features", F.lit(0.0), lambda acc, row: acc + row[1])
    return frames.withColumn("score", total / (SETTINGS.lookback * 100.0))


def batch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = stage(stream_shaped_windows(spark, sf_dir), "windows")
    return score_batch(windows, _mean_cpu_score, BATCH_THRESHOLD, "check", lookback=SETTINGS.lookback)


_LAST = SETTINGS.lookback - 1
CTES["batch_records"] = f"""SELECT *, {_MODE_SQL} AS predicted_failure_type,
    CASE WHEN score >= greatest(0.95e0, {BATCH_THRESHOLD}e0 + 0.12e0) THEN 'critical' WHEN score >= {BATCH_THRESHOLD}e0 THEN 'high'
      WHEN score >= {BATCH_THRESHOLD}e0 * 0.7e0 THEN 'medium' ELSE 'low' END AS risk_band,
    score >= {BATCH_THRESHOLD}e0 AS alert_fired, {BATCH_THRESHOLD}e0 AS threshold, 'check' AS model_version,
    score AS p_fail_5m
  FROM (SELECT *, 1e0 - heartbeat_ok_mean AS heartbeat_drop_ratio, count(*) OVER f AS steps,
          coalesce(mem_pct_mean - lag(mem_pct_mean) OVER m, 0e0) AS mem_delta,
          sum(coalesce(cpu_pct_max, 0)) OVER f / {SETTINGS.lookback * 100}e0 AS score
        FROM (SELECT * REPLACE (coalesce(cpu_pct_mean, 0) AS cpu_pct_mean) FROM stream_windows)
        WINDOW m AS (PARTITION BY machine_id ORDER BY window_end),
               f AS (PARTITION BY machine_id ORDER BY window_end ROWS BETWEEN {_LAST} PRECEDING AND CURRENT ROW))
  WHERE steps = {SETTINGS.lookback}"""
_RECORD = (
    f"{KEY} cluster_id role window_start:us p_fail_5m:6 risk_band predicted_failure_type alert_fired:i threshold:4 "
    "model_version missing_ratio:4 cpu_pct_mean:4 mem_pct_mean:4 latency_p95_ms_mean:4 error_count_sum:4 "
    "queue_depth_mean:4 net_retransmit_pct_mean:4"
)


@query("h5_batch_scores", f"{KEY} p_fail_5m:6 risk_band alert_fired:i", "batch_records")
@query("b21_prediction_records", _RECORD, "batch_records")
def _(spark, sf_dir):
    return batch_records(spark, sf_dir)


@query("a14_search_predictions", f"{KEY} p_fail_5m:4 alert_fired:i cpu_pct_mean:2 error_count_sum:2 missing_ratio:2",
       "batch_records")
def _(spark, sf_dir):
    return conform(batch_records(spark, sf_dir), SEARCH_PREDICTION)


@query("d29_by_failure_type", "predicted_failure_type n:i",
       "SELECT predicted_failure_type, count(*) AS n FROM batch_records GROUP BY 1")
def _(spark, sf_dir):
    return dashboards.by_failure_type(batch_records(spark, sf_dir))


@query(
    "d31_run_summary",
    "windows_processed:i predictions_emitted:i",
    """SELECT (SELECT count(*) FROM stream_windows) AS windows_processed,
         (SELECT count(*) FROM batch_records) AS predictions_emitted""",
)
def _(spark, sf_dir):
    return dashboards.run_summary(stream_shaped_windows(spark, sf_dir), batch_records(spark, sf_dir))


_TIMELINE = """SELECT w.machine_id, w.window_end, w.cpu_pct_mean, w.mem_pct_mean, w.latency_p95_ms_mean, w.error_count_sum,
  r.p_fail_5m FROM stream_windows w LEFT JOIN batch_records r USING (machine_id, window_end)"""
_TIMELINE_SPEC = (
    f"{KEY} cpu_pct_mean:4 mem_pct_mean:4 latency_p95_ms_mean:4 error_count_sum:i p_fail_5m:6"
)


@query("j5_scores_over_windows", _TIMELINE_SPEC, _TIMELINE)
def _(spark, sf_dir):
    return dashboards.host_timeline(stream_shaped_windows(spark, sf_dir), batch_records(spark, sf_dir))


@query("l4_host_timeline", _TIMELINE_SPEC, _TIMELINE)
def _(spark, sf_dir):
    timeline = dashboards.host_timeline(
        stream_shaped_windows(spark, sf_dir), batch_records(spark, sf_dir)
    )
    return timeline.orderBy("machine_id", "window_end")


# ---- dashboards over the scores


@query("b22_early_warning", "seq risk_band missing_ratio:4",
       "SELECT * FROM predictions WHERE risk_band IN ('high', 'critical') AND missing_ratio BETWEEN 0 AND 0.5")
def _(spark, sf_dir):
    return dashboards.early_warning(predictions(spark, sf_dir))


@query("d30_machine_band_matrix", "machine_id low:i medium:i high:i critical:i",
       "SELECT machine_id, " + ", ".join(
           f"count(*) FILTER (risk_band = '{b}') AS {b}" for b in dashboards.BANDS
       ) + " FROM predictions GROUP BY 1")
def _(spark, sf_dir):
    return dashboards.machine_band_matrix(predictions(spark, sf_dir))


_LATEST = """SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY window_end DESC) = 1"""


@query("e10_fleet_latest", "machine_id window_end:us seq p_fail_5m:4 risk_band", _LATEST)
def _(spark, sf_dir):
    return dashboards.fleet_latest(predictions(spark, sf_dir))


@query("l3_fleet_risk", "machine_id window_end:us p_fail_5m:4 risk_band", _LATEST)
def _(spark, sf_dir):
    return dashboards.fleet_risk(predictions(spark, sf_dir))


@query("b23_fleet_gauge", "machine_id p_fail_5m:4 gauge_band",
       f"SELECT *, {_GAUGE_SQL} AS gauge_band FROM ({_LATEST})")
def _(spark, sf_dir):
    return dashboards.gauge(predictions(spark, sf_dir))


@query(
    "c3_latest_windows",
    "machine_id window_end:us seq p_fail_5m:4",
    """SELECT machine_id, day AS window_end, seq, p_fail_5m FROM (SELECT *, date_trunc('day', window_end) AS day FROM scores)
       QUALIFY row_number() OVER (PARTITION BY machine_id, day ORDER BY seq DESC) = 1""",
)
def _(spark, sf_dir):
    daily = scores(spark, sf_dir).withColumn("window_end", bucket_start("window_end", 86400))
    return latest_by_key(daily, arrival="seq")


# ---- alerts


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.evaluate_alerts(scores(spark, sf_dir), ALERT_WINDOW, ALERT_SLIDE)


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.confirm(evaluations(spark, sf_dir), ALERT_SLIDE_SECONDS)


@query("d32_alert_measure", "machine_id eval_at:us max_score:4 breached:i", "evaluations")
def _(spark, sf_dir):
    return evaluations(spark, sf_dir)


@query("e11_confirmed_alerts", "machine_id eval_at:us confirmed:i", "confirmations")
def _(spark, sf_dir):
    return confirmations(spark, sf_dir)


@query("e12_recoveries", "machine_id eval_at:us confirmed:i recovered:i", "recoveries")
def _(spark, sf_dir):
    return alerts.recover(stage(confirmations(spark, sf_dir), "confirmed"), ALERT_SLIDE_SECONDS)


_QUIET_US = QUIET_MINUTES * 60_000_000


CTES["fired_alerts"] = f"""WITH RECURSIVE al AS (SELECT machine_id, epoch_us(eval_at) AS t FROM confirmations WHERE confirmed),
  nxt AS (SELECT a.machine_id, a.t, min(b.t) AS after FROM al a JOIN al b
          ON a.machine_id = b.machine_id AND b.t >= a.t + {_QUIET_US} GROUP BY 1, 2),
  chain AS (SELECT machine_id, min(t) AS t FROM al GROUP BY 1
            UNION ALL SELECT n.machine_id, n.after FROM chain c JOIN nxt n ON n.machine_id = c.machine_id AND n.t = c.t)
  SELECT al.machine_id, make_timestamp(al.t) AS eval_at, chain.t IS NOT NULL AS fired
  FROM al LEFT JOIN chain ON chain.machine_id = al.machine_id AND chain.t = al.t"""


@query("e13_fired_alerts", "machine_id eval_at:us fired:i", "fired_alerts")
def _(spark, sf_dir):
    confirmed = stage(confirmations(spark, sf_dir).where("confirmed"), "alerts")
    return alerts.suppress(confirmed, QUIET_MINUTES)
