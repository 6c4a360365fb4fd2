"""Checked queries over the server-metrics table: cleaning, exploration, anomaly frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.catalog import expressions as _expressions  # noqa: F401  (registers the SQL)
from fleetpulse.catalog.registry import query
from fleetpulse.catalog.views import metrics_text
from fleetpulse.config import FAILURE_SCENARIOS, METRIC_COLUMNS
from fleetpulse.functions.parsing import (
    machine_key,
    parse_ts,
    to_number,
)
from fleetpulse.functions.vectors import flatten_features, squared_norm
from fleetpulse.operators import anomaly, explore, metrics_frames
from fleetpulse.operators.cleaning import (
    clean_metrics,
    explore_metrics,
    impute_medians,
    typed_metrics,
)
from fleetpulse.plans.analysis import run_anomaly_detection
from fleetpulse.session import scratch_path, stage
from fleetpulse.sources.files import read_metrics_csv

_TEXT = "timestamp machine " + " ".join(METRIC_COLUMNS)
_NUMBERS = " ".join(f"{c}:4" for c in METRIC_COLUMNS)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_metrics(metrics_text(spark, sf_dir))


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(explore_metrics(metrics_text(spark, sf_dir)), "explored")


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_frames.metric_sequences(clean(spark, sf_dir))


def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_frames.positional_split(stage(framed(spark, sf_dir), "frames"))


# ---- sources


def _csv(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    path = scratch_path(spark, "metrics-csv")
    table = metrics_text(spark, sf_dir).toDF(*names)
    # Blank names are quoted, so that a reader does not trim them away.
    table.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    return path


@query("a15_metrics_by_position", _TEXT, "metrics_text")
def _(spark, sf_dir):
    other_names = [f"column_{i}" for i in range(2 + len(METRIC_COLUMNS))]
    return read_metrics_csv(spark, _csv(spark, sf_dir, other_names), match="position")


@query("a16_metrics_by_name", _TEXT, "metrics_text")
def _(spark, sf_dir):
    path = _csv(spark, sf_dir, ["timestamp", "machine", *METRIC_COLUMNS])
    return read_metrics_csv(spark, path, match="name")


# ---- cleaning


@query("b2_epoch_or_log_time", "timestamp:us machine write_count:4", "timed_metrics")
def _(spark, sf_dir):
    return metrics_text(spark, sf_dir).withColumns(
        {"timestamp": parse_ts("timestamp"), "write_count": to_number("write_count")}
    )


@query(
    "b3_day_first_time",
    "written read_at:us",
    """SELECT timestamp AS written, coalesce(try_strptime(timestamp, '%d-%m-%y %H:%M:%S'),
         try_strptime(timestamp, '%d/%m/%Y %H:%M:%S')) AS read_at FROM metrics_text""",
)
def _(spark, sf_dir):
    return metrics_text(spark, sf_dir).select(
        F.col("timestamp").alias("written"),
        parse_ts("timestamp", day_first=True, epoch_first=False).alias("read_at"),
    )


@query(
    "b4_numeric_coercion",
    f"machine {_NUMBERS}",
    "SELECT machine, "
    + ", ".join(f"TRY_CAST(trim({c}) AS DOUBLE) AS {c}" for c in METRIC_COLUMNS)
    + " FROM metrics_text",
)
def _(spark, sf_dir):
    return metrics_text(spark, sf_dir).withColumns({c: to_number(c) for c in METRIC_COLUMNS})


@query(
    "b5_known_rows",
    "timestamp:us machine",
    "SELECT * FROM timed_metrics WHERE timestamp IS NOT NULL AND machine IS NOT NULL",
)
def _(spark, sf_dir):
    timed = metrics_text(spark, sf_dir).withColumn("timestamp", parse_ts("timestamp"))
    return timed.dropna(subset=["timestamp", "machine"])


@query("b6_recent_rows", "timestamp:us machine", "SELECT * FROM timed_metrics WHERE year(timestamp) >= 2025")
def _(spark, sf_dir):
    timed = metrics_text(spark, sf_dir).withColumn("timestamp", parse_ts("timestamp"))
    return timed.where(F.year("timestamp") >= 2025)


@query("b7_complete_rows", f"timestamp:us machine {_NUMBERS}", "clean_rows")
def _(spark, sf_dir):
    return clean(spark, sf_dir)


@query("b8_prepared_rows", f"timestamp:us machine {_NUMBERS}", "explored")
def _(spark, sf_dir):
    return explore_metrics(metrics_text(spark, sf_dir))


@query(
    "b9_machine_key",
    "name n:i",
    """SELECT CASE WHEN trim(coalesce(machine, '')) = '' THEN 'unknown' ELSE trim(machine) END AS name,
         count(*) AS n FROM metrics_text GROUP BY 1""",
)
def _(spark, sf_dir):
    named = metrics_text(spark, sf_dir).groupBy(machine_key("machine").alias("name"))
    return named.agg(F.count(F.lit(1)).alias("n"))


@query("d19_median_fill", f"timestamp:us machine {_NUMBERS}", "explored")
@query("j4_filled_by_machine", "timestamp:us machine read:4 cpu_usage:4", "explored")
def _(spark, sf_dir):
    return impute_medians(stage(typed_metrics(metrics_text(spark, sf_dir)), "typed"))


# ---- exploration


@query("d9_cpu_by_machine", "machine cpu_usage:6",
       "SELECT machine, avg(cpu_usage) AS cpu_usage FROM explored GROUP BY 1")
def _(spark, sf_dir):
    return explore.mean_by_machine(explored(spark, sf_dir), "cpu_usage")


@query("d9_gpu_by_machine", "machine gpu_wrk_util:6",
       "SELECT machine, avg(gpu_wrk_util) AS gpu_wrk_util FROM explored GROUP BY 1")
def _(spark, sf_dir):
    return explore.mean_by_machine(explored(spark, sf_dir), "gpu_wrk_util")


@query("d10_cpu_gpu_means", "machine cpu_usage:6 gpu_wrk_util:6",
       "SELECT machine, avg(cpu_usage) AS cpu_usage, avg(gpu_wrk_util) AS gpu_wrk_util FROM explored GROUP BY 1")
def _(spark, sf_dir):
    return explore.cpu_gpu_means(explored(spark, sf_dir))


@query("d11_cpu_over_time", "timestamp:us machine cpu_usage:6",
       "SELECT timestamp, machine, avg(cpu_usage) AS cpu_usage FROM explored GROUP BY 1, 2")
def _(spark, sf_dir):
    return explore.metric_over_time(explored(spark, sf_dir), "cpu_usage")


@query("d11_gpu_over_time", "timestamp:us machine gpu_wrk_util:6",
       "SELECT timestamp, machine, avg(gpu_wrk_util) AS gpu_wrk_util FROM explored GROUP BY 1, 2")
def _(spark, sf_dir):
    return explore.metric_over_time(explored(spark, sf_dir), "gpu_wrk_util")


@query(
    "d12_cpu_histogram",
    "bin:i lower:4 upper:4 n:i",
    """SELECT bin, lo + bin * (hi - lo) / 30 AS lower, lo + (bin + 1) * (hi - lo) / 30 AS upper, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(30)) AS bin, lo, hi FROM (SELECT min(cpu_usage) AS lo, max(cpu_usage) AS hi FROM explored))
       LEFT JOIN (SELECT least(29, CAST(floor((cpu_usage - lo) / ((hi - lo) / 30)) AS BIGINT)) AS bin, count(*) AS n
                  FROM explored, (SELECT min(cpu_usage) AS lo, max(cpu_usage) AS hi FROM explored)
                  WHERE cpu_usage IS NOT NULL GROUP BY 1) USING (bin)""",
)
def _(spark, sf_dir):
    return explore.histogram(explored(spark, sf_dir), "cpu_usage")


_FENCED = """SELECT e.machine, cpu_usage, q1, median, q3,
    cpu_usage BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM explored e
  JOIN (SELECT machine, quantile_cont(cpu_usage, 0.25) AS q1, quantile_cont(cpu_usage, 0.5) AS median,
          quantile_cont(cpu_usage, 0.75) AS q3 FROM explored GROUP BY 1) q USING (machine)"""


@query(
    "d13_cpu_box",
    "machine q1:4 median:4 q3:4 whisker_low:4 whisker_high:4 outliers:i",
    f"""SELECT machine, q1, median, q3, least(q1, min(cpu_usage) FILTER (inside)) AS whisker_low,
          greatest(q3, max(cpu_usage) FILTER (inside)) AS whisker_high,
          count(*) FILTER (NOT inside) AS outliers FROM ({_FENCED}) GROUP BY machine, q1, median, q3""",
)
def _(spark, sf_dir):
    return explore.box_stats(explored(spark, sf_dir))


@query("d13_write_outliers", "machine read_count:4",
       _FENCED.replace("cpu_usage", "read_count") .replace("SELECT e.machine", "SELECT * FROM (SELECT e.machine")
       + ") WHERE NOT inside")
def _(spark, sf_dir):
    return explore.box_outliers(explored(spark, sf_dir), "read_count")


@query(
    "d14_cpu_violin",
    "machine n:i min:4 max:4 mean:6 median:4",
    """SELECT machine, count(cpu_usage) AS n, min(cpu_usage) AS "min", max(cpu_usage) AS "max",
         avg(cpu_usage) AS mean, quantile_cont(cpu_usage, 0.5) AS median FROM explored GROUP BY 1""",
)
def _(spark, sf_dir):
    return explore.violin_stats(explored(spark, sf_dir))


@query(
    "d14_cpu_density",
    "machine point:i x:6 density:8",
    """SELECT machine, point, lo + point * (hi - lo) / 99 AS x,
         sum(exp(-0.5 * pow((lo + point * (hi - lo) / 99 - cpu_usage) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS density
       FROM explored JOIN (SELECT machine, min(cpu_usage) AS lo, max(cpu_usage) AS hi, count(cpu_usage) AS n,
                             stddev_samp(cpu_usage) * pow(count(cpu_usage), -0.2) AS h
                           FROM explored GROUP BY 1) USING (machine), range(100) AS g(point) GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    return explore.violin_density(explored(spark, sf_dir))


@query(
    "d15_correlations",
    "x y r:6",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS r FROM explored"
        for x in METRIC_COLUMNS
        for y in METRIC_COLUMNS
    ),
)
def _(spark, sf_dir):
    return explore.correlation_matrix(explored(spark, sf_dir))


@query("d16_usage_over_time", "timestamp:us cpu_usage:4 gpu_wrk_util:4",
       """SELECT timestamp, coalesce(sum(cpu_usage), 0) AS cpu_usage, coalesce(sum(gpu_wrk_util), 0) AS gpu_wrk_util
          FROM explored GROUP BY 1""")
def _(spark, sf_dir):
    return explore.sum_by(explored(spark, sf_dir), "timestamp", ["cpu_usage", "gpu_wrk_util"])


@query("d17_io_by_machine", "machine read:4 write:4",
       'SELECT machine, coalesce(sum("read"), 0) AS "read", coalesce(sum("write"), 0) AS "write" FROM explored GROUP BY 1')
def _(spark, sf_dir):
    return explore.sum_by(explored(spark, sf_dir), "machine", ["read", "write"])


@query("d18_io_over_time", "timestamp:us read:4 write:4",
       'SELECT timestamp, coalesce(sum("read"), 0) AS "read", coalesce(sum("write"), 0) AS "write" FROM explored GROUP BY 1')
def _(spark, sf_dir):
    return explore.sum_by(explored(spark, sf_dir), "timestamp", ["read", "write"])


@query("b24_cpu_vs_gpu", "machine cpu_usage:4 gpu_wrk_util:4", "explored")
def _(spark, sf_dir):
    return explore.scatter_points(explored(spark, sf_dir))


# ---- anomaly frames


@query("d5_minute_means", f"machine minute:us {_NUMBERS.replace(':4', ':6')}", "minutes")
def _(spark, sf_dir):
    return metrics_frames.minute_means(metrics_frames.span_filter(clean(spark, sf_dir)))


@query("d6_short_spans", "machine timestamp:us",
       "SELECT machine, timestamp FROM clean_rows WHERE machine IN (SELECT machine FROM short_spans)")
def _(spark, sf_dir):
    return metrics_frames.span_filter(clean(spark, sf_dir))


@query(
    "d7_enough_minutes",
    "machine minutes:i",
    "SELECT machine, count(*) AS minutes FROM minutes GROUP BY 1 HAVING count(*) > 10",
)
def _(spark, sf_dir):
    minutes = metrics_frames.minute_means(metrics_frames.span_filter(clean(spark, sf_dir)))
    scaled = metrics_frames.scaled_minutes(minutes)
    return scaled.groupBy("machine").agg(F.count(F.lit(1)).alias("minutes"))


@query(
    "d8_load_profile",
    "rows_loaded:i rows_kept:i machines:i",
    """SELECT (SELECT count(*) FROM metrics_text) AS rows_loaded, count(*) AS rows_kept,
         count(DISTINCT machine) AS machines FROM clean_rows""",
)
def _(spark, sf_dir):
    return metrics_frames.load_profile(metrics_text(spark, sf_dir), clean(spark, sf_dir))


@query(
    "d8_machine_spans",
    "machine first_log:us last_log:us minutes:i span_seconds:i",
    """SELECT machine, min(timestamp) AS first_log, max(timestamp) AS last_log,
         count(DISTINCT date_trunc('minute', timestamp)) AS minutes,
         epoch_us(max(timestamp)) // 1000000 - epoch_us(min(timestamp)) // 1000000 AS span_seconds
       FROM clean_rows GROUP BY 1""",
)
def _(spark, sf_dir):
    return metrics_frames.machine_spans(clean(spark, sf_dir))


@query("d22_machine_scaler", f"machine minute:us {_NUMBERS.replace(':4', ':6')}",
       "SELECT * FROM scaled_minutes WHERE minutes > 10")
def _(spark, sf_dir):
    minutes = metrics_frames.minute_means(metrics_frames.span_filter(clean(spark, sf_dir)))
    return metrics_frames.scaled_minutes(minutes)


def described_frames(frames: DataFrame) -> DataFrame:
    flat = frames.withColumn("flat", flatten_features("features"))
    return flat.withColumns(
        {
            "element_sum": F.aggregate("flat", F.lit(0.0), lambda a, x: a + x),
            "mean_square": squared_norm("flat") / F.size("flat"),
            "first_element": F.col("flat")[0],
            "last_element": F.element_at("flat", -1),
        }
    )


@query("e8_metric_frames", "machine start:us end:us element_sum:5 first_element:6 last_element:6",
       "metric_frames")
def _(spark, sf_dir):
    return described_frames(framed(spark, sf_dir))


@query("e9_positional_split", "machine start:us end:us position:i split", "split_frames")
def _(spark, sf_dir):
    return split_frames(spark, sf_dir)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split frames with their mean square in place of a model's reconstruction error."""
    described = described_frames(split_frames(spark, sf_dir))
    return stage(described.withColumnRenamed("mean_square", "error"), "errors")


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    errors = _errors(spark, sf_dir)
    train, test = (errors.where(F.col("split") == name) for name in ("train", "test"))
    return train, anomaly.flag_anomalies(train, test, q=0.9)


_FLAGGED_SQL = """SELECT *, mean_square AS error, mean_square > threshold AS anomaly FROM split_frames,
  (SELECT quantile_cont(mean_square, 0.9) AS threshold FROM split_frames WHERE split = 'train') WHERE split = 'test'"""


@query("d27_anomaly_flags", "position:i error:6 threshold:6 anomaly:i", _FLAGGED_SQL)
def _(spark, sf_dir):
    return _flagged(spark, sf_dir)[1]


@query(
    "d27_anomaly_summary",
    "train_mean:6 threshold:6 test_mean:6 anomalies:i test_rows:i",
    f"""SELECT (SELECT avg(mean_square) FROM split_frames WHERE split = 'train') AS train_mean,
          max(threshold) AS threshold, avg(error) AS test_mean, count(*) FILTER (anomaly) AS anomalies,
          count(*) AS test_rows FROM ({_FLAGGED_SQL})""",
)
def _(spark, sf_dir):
    return anomaly.anomaly_summary(*_flagged(spark, sf_dir))


@query(
    "l2_first_flagged",
    "position:i machine start:us end:us error:6",
    f"SELECT * FROM ({_FLAGGED_SQL}) WHERE anomaly ORDER BY position LIMIT 25",
)
def _(spark, sf_dir):
    return anomaly.first_flagged(_flagged(spark, sf_dir)[1])


# Element sums after injection: all ten steps of the overwritten metrics change.
_INJECTED_SQL = " UNION ALL ".join(
    f"""SELECT machine, "end", '{name}' AS scenario,
          element_sum {" ".join(f"- total_{c} + {10 * level}e0" for c, level in levels.items())} AS injected_sum
        FROM split_frames WHERE split = 'test'"""
    for name, levels in FAILURE_SCENARIOS.items()
)


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = anomaly.inject_scenarios(anomaly.injection_base(split_frames(spark, sf_dir)))
    total = F.aggregate(flatten_features("features"), F.lit(0.0), lambda a, x: a + x)
    return frames.withColumn("injected_sum", total)


@query("j6_injected_frames", "machine end:us scenario injected_sum:5", _INJECTED_SQL)
def _(spark, sf_dir):
    return _injected(spark, sf_dir)


@query(
    "d28_detection_rates",
    "scenario flagged:i total:i",
    f"""SELECT scenario, count(*) FILTER (injected_sum > 40.123e0) AS flagged, count(*) AS total
        FROM ({_INJECTED_SQL}) GROUP BY 1""",
)
def _(spark, sf_dir):
    return anomaly.detection_rates(_injected(spark, sf_dir), 40.123, error="injected_sum")


@query(
    "h8_reconstruction_anomalies",
    "position:i machine start:us end:us has_error:i",
    "SELECT *, true AS has_error FROM split_frames WHERE split = 'test'",
)
def _(spark, sf_dir):
    flagged = run_anomaly_detection(metrics_text(spark, sf_dir)).flagged
    has_error = F.col("error") >= 0
    same = F.col("anomaly") == (F.col("error") > F.col("threshold"))
    return flagged.withColumn("has_error", has_error & same)


@query(
    "h9_injected_failure_rates",
    "scenario total:i flagged_in_bounds:i",
    f"""SELECT scenario, count(*) AS total, true AS flagged_in_bounds
        FROM ({_INJECTED_SQL}) GROUP BY 1""",
)
def _(spark, sf_dir):
    rates = run_anomaly_detection(metrics_text(spark, sf_dir)).injected
    return rates.withColumn("flagged_in_bounds", F.col("flagged").between(0, F.col("total")))
