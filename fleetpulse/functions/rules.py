"""Rules that turn scores and measures into bands, modes and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.functions.parsing import no_nan

# Fixed values: (mode, {measure: bound it must exceed}, {measure: bound it must stay under}).
FAILURE_RULES = (
    ("memory_leak", {"mem_pct_mean": 88.0, "mem_delta": 0.0}, {}),
    ("cpu_saturation", {"cpu_pct_mean": 88.0, "queue_depth_mean": 30.0}, {}),
    ("network_meltdown", {"net_retransmit_pct_mean": 4.0}, {}),
    ("disk_exhaustion", {"disk_used_pct_mean": 92.0, "disk_io_wait_pct_mean": 35.0}, {}),
    ("gpu_oom", {"gpu_mem_pct_mean": 90.0}, {"gpu_util_pct_mean": 30.0}),
    ("app_crash", {"heartbeat_drop_ratio": 0.3, "error_count_sum": 10.0}, {}),
)

# Gauge breaks of the dashboard (not the model's bands).
GAUGE_BREAKS = ((0.8, "critical"), (0.35, "high"), (0.25, "medium"))


def _as_column(value: str | float | Column) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return F.lit(float(value)) if isinstance(value, (int, float)) else value


def failure_mode_col() -> Column:
    """Likely failure mode of a window: the first rule that holds, else ``unknown``.

    Absent and not-a-number measures count as zero, so they satisfy no lower bound.
    """

    def measure(name: str) -> Column:
        return F.coalesce(no_nan(F.col(name).cast("double")), F.lit(0.0))

    chain = F
    for mode, above, below in FAILURE_RULES:
        holds = reduce(
            lambda a, b: a & b,
            [measure(m) > bound for m, bound in above.items()]
            + [measure(m) < bound for m, bound in below.items()],
        )
        chain = chain.when(holds, mode)
    return chain.otherwise("unknown")


def risk_band_col(score: str | Column, threshold: float | Column) -> Column:
    """Band of a score relative to the model's decision threshold."""
    score, threshold = _as_column(score), _as_column(threshold)
    return (
        F.when(score >= F.greatest(F.lit(0.95), threshold + 0.12), "critical")
        .when(score >= threshold, "high")
        .when(score >= threshold * 0.7, "medium")
        .otherwise("low")
    )


def alert_col(score: str | Column, threshold: float | Column) -> Column:
    return _as_column(score) >= _as_column(threshold)


def gauge_band_col(score: str | Column) -> Column:
    """Band of the dashboard gauge, from fixed breaks."""
    score, chain = _as_column(score), F
    for lower, band in GAUGE_BREAKS:
        chain = chain.when(score >= lower, band)
    return chain.otherwise("low")
