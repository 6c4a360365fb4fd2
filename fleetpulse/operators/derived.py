"""Derived model inputs of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fleetpulse.operators.ordered import grid_slices, own_rows, position_slices

DELTAS = {
    "cpu_delta": "cpu_pct_mean",
    "mem_delta": "mem_pct_mean",
    "latency_delta": "latency_p95_ms_mean",
    "queue_delta": "queue_depth_mean",
}


def delta_columns(frame: WindowSpec) -> dict[str, Column]:
    """First differences along ``frame``; the first row has none and gets 0."""
    return {
        name: F.coalesce(F.col(source) - F.lag(source).over(frame), F.lit(0.0))
        for name, source in DELTAS.items()
    }


def row_columns() -> dict[str, Column]:
    return {
        "throughput_total": (F.col("net_rx_bytes_sum") + F.col("net_tx_bytes_sum")).cast("double"),
        "heartbeat_drop_ratio": F.lit(1.0) - F.col("heartbeat_ok_mean"),
        "error_rate": F.col("error_count_sum") / F.greatest("request_rate_mean", F.lit(1.0)),
    }


def add_derived(windows: DataFrame, bucket: int | None = None) -> DataFrame:
    """Add the seven derived inputs, with differences against the machine's real history.

    Give ``bucket`` when the windows are dense on that grid: the slices then need no
    row positions.
    """
    if bucket:
        framed, frame = grid_slices(windows, ["machine_id"], "window_end", bucket, back=1)
    else:
        framed, frame = position_slices(windows, ["machine_id"], "window_end", back=1)
    return own_rows(framed.withColumns(delta_columns(frame) | row_columns())).select(
        *windows.columns, *DELTAS, *row_columns()
    )
