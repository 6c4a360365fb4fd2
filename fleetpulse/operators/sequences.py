"""Look-back sequences: the last N windows of a machine, as one array per row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import MODEL_COLUMNS
from fleetpulse.operators.derived import DELTAS, delta_columns, row_columns
from fleetpulse.operators.ordered import grid_slices, own_rows, position_slices
from fleetpulse.operators.splitting import params_row


def sequences(
    df: DataFrame,
    lookback: int = 20,
    cols: Sequence[str] = MODEL_COLUMNS,
    missing_max: float = 0.8,
    missing_on: str = "scaled",
    keys: Sequence[str] = ("split", "machine_id"),
    bucket: int | None = None,
) -> DataFrame:
    """Training sequences of eligible windows with a full look-back in the same split.

    A sequence is dropped when the mean missing ratio of its frame exceeds
    ``missing_max``. ``missing_on`` chooses the ratio: as scaled for the model, or the
    ``missing_ratio_raw`` column. Earlier rows of a frame may be ineligible.
    """
    keys = list(keys)
    if bucket:
        framed, frame = grid_slices(df, keys, "window_end", bucket, back=lookback - 1)
    else:
        framed, frame = position_slices(df, keys, "window_end", back=lookback - 1)
    steps = frame.rowsBetween(-(lookback - 1), 0)
    missing = "missing_ratio" if missing_on == "scaled" else "missing_ratio_raw"
    measured = framed.select(
        *keys,
        "window_end",
        F.col("target_failure_within_horizon").alias("label"),
        "lead_time_sec",
        "eligible_for_training",
        "_slice",
        "_home",
        F.count(F.lit(1)).over(steps).alias("_steps"),
        F.avg(F.col(missing).cast("double")).over(steps).alias("_missing"),
        F.collect_list(F.array(*[F.col(c).cast("float") for c in cols])).over(steps).alias(
            "features"
        ),
    )
    return own_rows(measured).where(
        (F.col("_steps") == lookback)
        & F.col("eligible_for_training")
        & (F.col("_missing") <= missing_max)
    ).select(*keys, "window_end", "label", "lead_time_sec", "features")


def scoring_frames(
    windows: DataFrame, lookback: int = 20, cols: Sequence[str] = MODEL_COLUMNS
) -> DataFrame:
    """Frames for scoring a window table: every window with ``lookback`` observed windows.

    Gaps are not filled, nothing is filtered, and differences start at 0 within each
    frame, as for a scorer that only knows its buffer. Absent measures count as 0. Adds
    ``features`` (unscaled) and the derived columns of the latest window.
    """
    present = windows.fillna(0)
    framed, frame = position_slices(present, ["machine_id"], "window_end", back=lookback - 1)
    steps = frame.rowsBetween(-(lookback - 1), 0)
    deltas = [i for i, c in enumerate(cols) if c in DELTAS]
    derived = framed.withColumns(delta_columns(frame) | row_columns())
    measured = derived.withColumns(
        {
            "_steps": F.count(F.lit(1)).over(steps),
            "features": F.collect_list(F.array(*[F.col(c).cast("float") for c in cols])).over(steps),
        }
    )

    def restart(row, step):
        zeroed = F.transform(
            row,
            lambda x, i: F.when(i.isin(deltas), F.lit(0.0).cast("float")).otherwise(x),
        )
        return F.when(step == 0, zeroed).otherwise(row)

    return (
        own_rows(measured)
        .where(F.col("_steps") == lookback)
        .drop("_steps")
        .withColumn("features", F.transform("features", restart))
    )


def buffer_features(frame: str | Column, cols: Sequence[str] = MODEL_COLUMNS) -> Column:
    """Model inputs of a frame given as an array of window structs in time order."""
    frame = F.col(frame) if isinstance(frame, str) else frame

    return F.transform(
        frame, lambda row, i: _step_features(lambda c: row[c], lambda c: F.get(frame, i - 1)[c], i, cols)
    )


def flat_features(
    value: Callable[[str, Column], Column], lookback: int, cols: Sequence[str] = MODEL_COLUMNS
) -> Column:
    """The same inputs of a frame of ``lookback`` windows; ``value`` gives a measure of a step."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(lookback - 1)),
        lambda i: _step_features(lambda c: value(c, i), lambda c: value(c, i - 1), i, cols),
    )


def _step_features(
    now: Callable[[str], Column], before: Callable[[str], Column], i: Column, cols: Sequence[str]
) -> Column:
    derived = {
        name: F.when(i == 0, F.lit(0.0)).otherwise(now(source) - before(source))
        for name, source in DELTAS.items()
    } | {
        "throughput_total": (now("net_rx_bytes_sum") + now("net_tx_bytes_sum")).cast("double"),
        "heartbeat_drop_ratio": F.lit(1.0) - now("heartbeat_ok_mean"),
        "error_rate": now("error_count_sum") / F.greatest(now("request_rate_mean"), F.lit(1.0)),
    }
    return F.array(*[(derived[c] if c in derived else now(c)).cast("float") for c in cols])


def scale_frames(
    df: DataFrame, params: DataFrame, cols: Sequence[str] = MODEL_COLUMNS
) -> DataFrame:
    """Apply stored min-max parameters to every step of ``features``."""

    def per_feature(field: str) -> Column:
        return F.array(*[F.col(f"_params.{field}_{c}") for c in cols])

    def scaled(row: Column) -> Column:
        grown = F.zip_with(row, F.col("_scale"), lambda x, scale: x * scale)
        return F.zip_with(grown, F.col("_min"), lambda x, low: (x + low).cast("float"))

    return (
        df.withColumn("_params", params_row(params, cols, "float"))
        .withColumns({"_scale": per_feature("scale"), "_min": per_feature("min")})
        .withColumn("features", F.transform("features", scaled))
        .drop("_params", "_scale", "_min")
    )
