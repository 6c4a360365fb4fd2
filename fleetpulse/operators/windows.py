"""Feature windows: fixed time buckets per machine, dense in batch, observed-only in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetpulse.functions.parsing import bucket_start, expected_rows_per_bucket, missing_ratio
from fleetpulse.operators.cleaning import dedupe_events
from fleetpulse.operators.ordered import SLICE_ROWS, grid_slices, own_rows, range_count
from fleetpulse.schemas import FEATURE_WINDOW

WINDOW_COLUMNS = FEATURE_WINDOW.fieldNames()
IDENTITY = ["machine_id", "cluster_id", "role"]
FILL_LIMIT = 2

# Which reductions each raw measure gets.
_REDUCTIONS = {
    "cpu_pct": ("mean", "max"),
    "mem_pct": ("mean", "max"),
    "gpu_util_pct": ("mean",),
    "gpu_mem_pct": ("mean",),
    "disk_used_pct": ("mean",),
    "disk_io_wait_pct": ("mean", "max"),
    "net_rx_bytes": ("sum",),
    "net_tx_bytes": ("sum",),
    "net_retransmit_pct": ("mean",),
    "request_rate": ("mean",),
    "latency_p95_ms": ("mean", "max"),
    "error_count": ("sum",),
    "queue_depth": ("mean",),
    "restart_count": ("sum",),
    "heartbeat_ok": ("mean",),
    "gt_phase_code": ("max",),
    "gt_is_failure_now": ("max",),
}
_SUMS = [f"{m}_sum" for m, kinds in _REDUCTIONS.items() if "sum" in kinds]
_CARRIED = [
    f"{m}_{kind}"
    for m, kinds in _REDUCTIONS.items()
    for kind in kinds
    if kind != "sum" and not m.startswith("gt_")
]
_FLAGS = ["gt_phase_code_max", "gt_is_failure_now_max"]


def bucket_measures(counted: str | None) -> list[Column]:
    """The reductions of one bucket; all have fixed-width buffers, so they hash-aggregate
    with map-side partials. ``counted`` names the column whose non-nulls are the events."""
    reduce_by = {"mean": F.avg, "max": F.max, "sum": F.sum}
    measures = [
        reduce_by[kind](raw).alias(f"{raw}_{kind}")
        for raw, kinds in _REDUCTIONS.items()
        for kind in kinds
    ]
    return [*measures, F.count(counted or F.lit(1)).alias("event_count")]


def _check_bucket(bucket: int) -> None:
    if bucket <= 0 or 86400 % bucket:
        raise ValueError(f"A bucket of {bucket} s does not divide a day.")


def observed_buckets(events: DataFrame, bucket: int) -> DataFrame:
    """One row per (machine, bucket) that has events, with all 22 reductions."""
    keyed = events.where(F.col("machine_id").isNotNull() & F.col("event_time").isNotNull())
    return (
        keyed.groupBy("machine_id", bucket_start("event_time", bucket).alias("window_start"))
        .agg(*bucket_measures("sequence_no"))
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in _SUMS})
    )


def machine_identity(events: DataFrame) -> DataFrame:
    """Cluster and role of each machine's earliest event, and its first and last event time.

    The raw rows are reduced per identity with fixed-width buffers; only the few
    identities of a machine reach the second step.
    """
    seen = (
        events.where(F.col("machine_id").isNotNull() & F.col("event_time").isNotNull())
        .groupBy(*IDENTITY)
        .agg(F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))
    )
    earliest = F.struct("first_seen", "cluster_id", "role")
    return (
        seen.groupBy("machine_id")
        .agg(F.min(earliest).alias("_first"), F.max("last_seen").alias("last_seen"))
        .select("machine_id", "_first.cluster_id", "_first.role", "_first.first_seen", "last_seen")
    )


def machine_spine(events: DataFrame, bucket: int) -> DataFrame:
    """Every bucket between a machine's first and last event, empty ones included."""
    cell = lambda c: F.floor(F.unix_seconds(c) / F.lit(bucket)).cast("bigint")
    block = lambda c: F.floor(F.col(c) / F.lit(SLICE_ROWS)).cast("bigint")
    reach = machine_identity(events).select(
        *IDENTITY, cell("first_seen").alias("_lo"), cell("last_seen").alias("_hi")
    )
    blocks = reach.withColumn("_block", F.explode(F.sequence(block("_lo"), block("_hi"))))
    # The blocks are few bytes but grow a thousandfold: spread them first, in a fixed
    # number of partitions that adaptive coalescing leaves alone.
    blocks = blocks.repartition(range_count(events), "machine_id", "_block")
    cells = blocks.withColumn(
        "_cell",
        F.explode(
            F.sequence(
                F.greatest("_lo", F.col("_block") * SLICE_ROWS),
                F.least("_hi", F.col("_block") * SLICE_ROWS + SLICE_ROWS - 1),
            )
        ),
    )
    return cells.select(*IDENTITY, F.timestamp_seconds(F.col("_cell") * bucket).alias("window_start"))


def dense_buckets(events: DataFrame, bucket: int) -> DataFrame:
    """The spine with the observed reductions attached; empty buckets have null means.

    Both sides are unique on (machine, bucket), so the join cannot skew, and the
    aggregate's own partitioning serves the join.
    """
    return machine_spine(events, bucket).join(
        observed_buckets(events, bucket), ["machine_id", "window_start"], "left"
    )


def filled(dense: DataFrame, frame: WindowSpec, bucket: int, tick: int) -> DataFrame:
    """Gap-filled windows: means and maxima are carried over at most two buckets, then 0."""
    expected = expected_rows_per_bucket(tick, bucket)
    count = F.coalesce("event_count", F.lit(0))

    def carried(name: str) -> Column:
        earlier = [F.lag(name, back).over(frame) for back in range(1, FILL_LIMIT + 1)]
        return F.coalesce(name, *earlier, F.lit(0.0))

    return dense.withColumns(
        {c: carried(c) for c in _CARRIED}
        | {c: F.coalesce(c, F.lit(0)) for c in [*_SUMS, *_FLAGS]}
        | {
            "event_count": count,
            "missing_ratio": missing_ratio(count, expected),
            "window_end": F.timestamp_seconds(F.unix_seconds("window_start") + bucket),
        }
    )


def _batch_windows(events: DataFrame, bucket: int, tick: int) -> DataFrame:
    dense = dense_buckets(events, bucket)
    framed, frame = grid_slices(dense, ["machine_id"], "window_start", bucket, FILL_LIMIT)
    return own_rows(filled(framed, frame, bucket, tick)).select(*WINDOW_COLUMNS)


def _observed_windows(
    events: DataFrame, bucket: int, tick: int, watermark: str | None, dedupe: bool
) -> DataFrame:
    if dedupe:
        events = dedupe_events(events, watermark)
    elif watermark and events.isStreaming:
        events = events.withWatermark("event_time", watermark)
    expected = expected_rows_per_bucket(tick, bucket)
    return (
        events.groupBy(F.window("event_time", f"{bucket} seconds").alias("_w"), *IDENTITY)
        .agg(*bucket_measures(None))
        .withColumns(
            {
                "window_start": F.col("_w.start"),
                "window_end": F.col("_w.end"),
                "missing_ratio": missing_ratio("event_count", expected, clip=False),
            }
        )
        .select(*WINDOW_COLUMNS)
    )


def feature_windows(
    df: DataFrame,
    bucket: int = 30,
    tick: int = 5,
    mode: str = "batch",
    watermark: str | None = "2 minutes",
    dedupe: bool | None = None,
) -> DataFrame:
    """Feature windows of typed events.

    ``batch`` gives a dense, gap-filled series per machine, with the identity of its
    earliest event. ``stream`` gives the observed buckets only, keyed by machine,
    cluster and role, with repeats removed; it also runs on a static frame.
    """
    _check_bucket(bucket)
    if mode == "batch":
        return _batch_windows(dedupe_events(df) if dedupe else df, bucket, tick)
    if mode == "stream":
        return _observed_windows(df, bucket, tick, watermark, dedupe is not False)
    raise ValueError(f"Unknown mode {mode!r}: use 'batch' or 'stream'.")
