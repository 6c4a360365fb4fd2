"""Validation, de-duplication and clean-up of incoming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import METRIC_COLUMNS
from fleetpulse.functions.parsing import (
    machine_key,
    parse_ts,
    to_number,
)
from fleetpulse.operators.ordered import counted_quantiles
from fleetpulse.schemas import RAW_COLUMNS
from fleetpulse.session import stage


def check_events(
    df: DataFrame, required: Sequence[str] = RAW_COLUMNS, value: str = "value"
) -> DataFrame:
    """Add ``reason`` to JSON payloads: null when accepted.

    A required key must be present; its value may be null. Text that is not a JSON
    object is rejected, as is an event time that cannot be read (it could not be
    bucketed and would vanish silently).
    """
    text = F.col(value).cast("string")
    missing = F.array_except(F.array(*map(F.lit, required)), F.json_object_keys(text))
    reason = (
        F.when(F.json_object_keys(text).isNull(), "malformed")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
    )
    if "event_time" in required:
        readable = F.try_to_timestamp(F.get_json_object(text, "$.event_time")).isNotNull()
        reason = reason.when(~readable, "unreadable event_time")
    return df.withColumn("reason", reason)


def split_valid(
    df: DataFrame, required: Sequence[str] = RAW_COLUMNS, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Accepted payloads, and rejects with their reason (for the dead-letter stream)."""
    checked = check_events(df, required, value)
    return (
        checked.where(F.col("reason").isNull()).drop("reason"),
        checked.where(F.col("reason").isNotNull()),
    )


def dedupe_events(df: DataFrame, watermark: str | None = None) -> DataFrame:
    """One row per (machine, sequence number): in batch the earliest one.

    On a stream the watermark comes first, which lets the de-duplication state expire.
    """
    keys = ["machine_id", "sequence_no"]
    if df.isStreaming:
        return df.withWatermark("event_time", watermark or "2 minutes").dropDuplicatesWithinWatermark(
            keys
        )
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col("event_time").isNull(), "event_time")
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def incidents(df: DataFrame) -> DataFrame:
    """Distinct incidents with a known start."""
    columns = ["machine_id", "gt_incident_id", "gt_failure_type", "gt_failure_start_ts"]
    known = (
        F.col("machine_id").isNotNull()
        & F.col("gt_incident_id").isNotNull()
        & F.col("gt_failure_start_ts").isNotNull()
    )
    return df.where(known).select(columns).distinct()


def latest_by_key(
    df: DataFrame,
    keys: Sequence[str] = ("machine_id", "window_end"),
    arrival: str | Column = "arrival",
) -> DataFrame:
    """The last arrival per key: later refinements replace earlier ones.

    An aggregate rather than a ranking window, so that repeated arrivals of one key
    are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), arrival).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def clean_metrics(df: DataFrame, min_year: int = 2025) -> DataFrame:
    """Rows fit for anomaly detection: time and machine known, recent, every metric numeric."""
    typed = df.withColumns(
        {"timestamp": parse_ts("timestamp")}
        | {c: to_number(c) for c in METRIC_COLUMNS}
    )
    return (
        typed.dropna(subset=["timestamp", "machine"])
        .where(F.year("timestamp") >= min_year)
        .dropna("any", subset=METRIC_COLUMNS)
    )


def typed_metrics(df: DataFrame) -> DataFrame:
    """Rows for exploration: keys normalised, text coerced, rows without a time dropped."""
    return df.withColumns(
        {
            "timestamp": parse_ts("timestamp", day_first=True, epoch_first=False),
            "machine": machine_key("machine"),
        }
        | {c: to_number(c) for c in METRIC_COLUMNS}
    ).dropna(subset=["timestamp"])


def impute_medians(
    df: DataFrame, key: str = "machine", cols: Sequence[str] = METRIC_COLUMNS
) -> DataFrame:
    """Fill nulls with the key's median, then with the median of the filled column.

    One pass counts the values of all columns per key, nulls included. Both medians
    follow from these counts: filling a key's nulls adds its null count to its median.
    The second and last pass fills.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_metric"), F.col(c).alias("_x")) for c in cols])
    counts = stage(
        df.select(key, F.inline(pairs))
        .groupBy(key, "_metric", "_x")
        .agg(F.count(F.lit(1)).alias("_n")),
        "value-counts",
    )
    per_key = stage(
        counted_quantiles(counts, [key, "_metric"], "_x", "_n", {"_m": 0.5}), "medians"
    )
    filled_counts = (
        counts.join(per_key, [key, "_metric"], "left")
        .groupBy("_metric", F.coalesce("_x", "_m").alias("_x"))
        .agg(F.sum("_n").alias("_n"))
    )
    overall = counted_quantiles(stage(filled_counts, "filled-counts"), ["_metric"], "_x", "_n", {"_m": 0.5})

    def wide(medians: DataFrame, keys: list[str]) -> DataFrame:
        return medians.groupBy(*keys).agg(
            *[F.max(F.when(F.col("_metric") == c, F.col("_m"))).alias(f"_m_{c}") for c in cols]
        )

    row = wide(overall, []).select(F.struct("*").alias("_row")).scalar()
    fills = {c: F.coalesce(c, f"_m_{c}", f"_row._m_{c}") for c in cols}
    return (
        df.join(wide(per_key, [key]), key, "left")
        .withColumn("_row", row)
        .withColumns(fills)
        .select(*df.columns)
    )


def explore_metrics(df: DataFrame) -> DataFrame:
    """The full preparation for exploration: typed, imputed, rows without any metric dropped.

    The typed rows are written once: text is parsed in a single pass over the input.
    """
    typed = stage(typed_metrics(df), "typed-metrics")
    return impute_medians(typed).dropna("all", subset=METRIC_COLUMNS)


def require_rows(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Raise when nothing is left or no time could be parsed. Runs one aggregate."""
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count(time).alias("times")).first()
    if seen["rows"] == 0:
        raise ValueError("No usable rows remain after preprocessing.")
    if seen["times"] == 0:
        raise ValueError("No timestamp in the input could be parsed.")
    return df


def ordered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in key order, for output only: nothing inside the engine depends on it."""
    return df.orderBy(*keys)
