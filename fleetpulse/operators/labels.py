"""Failure labels: does a failure start soon after a window ends?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.operators.ordered import grid_index


def _earliest_per_second(starts: DataFrame) -> DataFrame:
    """Window ends are whole seconds, so within (s-1, s] only the earliest start matters.
    This bounds the failure rows of a slice whatever the incident table holds."""
    closing_second = F.ceil(F.unix_micros("gt_failure_start_ts") / F.lit(1_000_000))
    return (
        starts.where(F.col("gt_failure_start_ts").isNotNull())
        .groupBy("machine_id", closing_second.alias("_second"))
        .agg(F.min("gt_failure_start_ts").alias("_start"))
        .drop("_second")
    )


def label_windows(
    windows: DataFrame, incident_table: DataFrame, horizon_minutes: float = 5
) -> DataFrame:
    """Add the label, the lead time and the training eligibility.

    A failure counts when it starts strictly after the window's end and at most
    ``horizon_minutes`` later. Windows and failure starts are laid on one time line per
    (machine, slice); each start is also placed in the slice before it when a window
    there can reach it, so a slice answers all its windows by itself.
    """
    horizon = round(horizon_minutes * 60_000_000)
    span = max(86400, -(-horizon // 1_000_000))
    on_line = windows.withColumns(
        {"_at": F.col("window_end"), "_slice": grid_index("window_end", span)}
    ).withColumn("_kind", F.lit(1))
    slice_of = lambda micros: F.floor(micros / F.lit(span * 1_000_000)).cast("bigint")
    starts = (
        _earliest_per_second(incident_table)
        .withColumn("_at", F.col("_start"))
        .withColumn(
            "_slice",
            F.explode(
                F.sequence(
                    slice_of(F.unix_micros("_start") - F.lit(horizon)),
                    slice_of(F.unix_micros("_start")),
                )
            ),
        )
        .withColumn("_kind", F.lit(0))
    )
    # Newest first, windows before failures at the same instant: the last failure seen
    # so far is then the next one in time, and one that coincides with the end is not seen.
    newest_first = (
        W.partitionBy("machine_id", "_slice")
        .orderBy(F.desc("_at"), F.desc("_kind"))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    upcoming = F.last("_start", ignorenulls=True).over(newest_first)
    lead = F.unix_micros("_next") - F.unix_micros("window_end")
    within = F.coalesce(lead <= F.lit(horizon), F.lit(False))
    return (
        on_line.unionByName(starts, allowMissingColumns=True)
        .withColumn("_next", upcoming)
        .where(F.col("_kind") == 1)
        .select(
            *windows.columns,
            within.cast("int").alias("target_failure_within_horizon"),
            F.when(within, lead / F.lit(1e6)).alias("lead_time_sec"),
            (
                (F.col("gt_is_failure_now_max") == 0) & (F.col("gt_phase_code_max") <= 2)
            ).alias("eligible_for_training"),
        )
    )
