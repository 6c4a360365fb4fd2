"""Chronological split, min-max scaling and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import MODEL_COLUMNS
from fleetpulse.operators.ordered import exact_quantiles

SPLITS = ("train", "validation", "test")


def time_cutoffs(
    windows: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15
) -> DataFrame:
    """One row: the interpolated quantiles of ``window_end``, in microseconds."""
    ends = windows.select(F.unix_micros("window_end").cast("double").alias("_end"))
    return exact_quantiles(
        ends, [], "_end", {"train_cutoff": train_ratio, "val_cutoff": train_ratio + val_ratio}
    )


def split_by_time(
    windows: DataFrame, train_ratio: float = 0.7, val_ratio: float = 0.15
) -> DataFrame:
    """Add ``split``: train up to the first cut-off, validation up to the second, then test."""
    cutoffs = time_cutoffs(windows, train_ratio, val_ratio)
    row = cutoffs.select(F.struct("train_cutoff", "val_cutoff").alias("_cut")).scalar()
    end = F.unix_micros("window_end")
    return (
        windows.withColumn("_cut", row)
        .withColumn(
            "split",
            F.when(end <= F.col("_cut.train_cutoff"), "train")
            .when(end <= F.col("_cut.val_cutoff"), "validation")
            .otherwise("test"),
        )
        .drop("_cut")
    )


def require_splits(df: DataFrame) -> DataFrame:
    """Raise when one of the splits is empty. Runs one aggregate."""
    found = {row["split"] for row in df.select("split").distinct().collect()}
    absent = [name for name in SPLITS if name not in found]
    if absent:
        raise ValueError(f"Not enough history: no rows in {', '.join(absent)}.")
    return df


def fit_minmax(df: DataFrame, cols: Sequence[str] = MODEL_COLUMNS) -> DataFrame:
    """Scaling parameters, one row per feature, from a single aggregate.

    A constant feature keeps scale 1, so it scales to 0.
    """
    bounds = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"_lo_{c}") for c in cols],
        *[F.max(F.col(c).cast("double")).alias(f"_hi_{c}") for c in cols],
    )
    tall = bounds.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"_lo_{c}").alias("data_min"),
                        F.col(f"_hi_{c}").alias("data_max"),
                    )
                    for c in cols
                ]
            )
        )
    )
    width = F.col("data_max") - F.col("data_min")
    scale = F.when(width == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), width))
    return tall.withColumn("scale", scale).withColumn("min", -F.col("data_min") * F.col("scale"))


def params_row(params: DataFrame, cols: Sequence[str], kind: str = "double") -> Column:
    """The parameter table as one struct value with ``scale_<c>`` and ``min_<c>`` fields."""

    def picked(field: str, c: str) -> Column:
        value = F.max(F.when(F.col("feature") == c, F.col(field)))
        return value.cast(kind).alias(f"{field}_{c}")

    fields = [picked(field, c) for field in ("scale", "min") for c in cols]
    return params.agg(*fields).select(F.struct("*").alias("_params")).scalar()


def apply_minmax(
    df: DataFrame, params: DataFrame, cols: Sequence[str] = MODEL_COLUMNS, saved: bool = False
) -> DataFrame:
    """``x * scale + min`` per feature, in single precision, without clipping.

    ``saved`` repeats the arithmetic of scoring with stored parameters, which is single
    precision throughout; otherwise only the result is narrowed.
    """
    kind = "float" if saved else "double"

    def scaled(c: str) -> Column:
        value = F.col(c).cast(kind) * F.col(f"_params.scale_{c}") + F.col(f"_params.min_{c}")
        return value.cast("float")

    row = params_row(params, cols, kind)
    return df.withColumn("_params", row).withColumns({c: scaled(c) for c in cols}).drop("_params")


def class_balance(df: DataFrame, label: str = "label", cap: float = 20.0) -> DataFrame:
    """One row: positives, negatives and the weight that positives get."""
    counts = df.agg(
        F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("positive"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("negative", F.col("total") - F.col("positive"))
    ratio = F.col("negative") / F.greatest(F.lit(1), F.col("positive"))
    weight = F.least(F.lit(float(cap)), F.greatest(F.lit(1.0), ratio))
    return counts.select("positive", "negative", weight.alias("positive_weight"))


def class_weight(df: DataFrame, label: str = "label", cap: float = 20.0) -> DataFrame:
    """Add ``weight``: 1 for negatives, the balance ratio for positives."""
    positive = class_balance(df, label, cap).select("positive_weight").scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(F.lit(1.0)))


def dataset_summary(sequences: DataFrame) -> DataFrame:
    """One row: sequences and positive sequences per split."""

    def counted(name: str):
        return F.count_if(F.col("split") == name).alias(f"{name}_sequences")

    def positives(name: str):
        hit = (F.col("split") == name) & (F.col("label") == 1)
        return F.count_if(hit).alias(f"positive_{name}_sequences")

    return sequences.agg(*[counted(s) for s in SPLITS], *[positives(s) for s in SPLITS])
