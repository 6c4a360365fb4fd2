"""Anomaly detection by reconstruction error on metric frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import FAILURE_SCENARIOS, METRIC_COLUMNS
from fleetpulse.functions.vectors import feature_vector, flatten_features, squared_norm
from fleetpulse.operators.ordered import exact_quantiles


@dataclass
class Reconstruction:
    """A linear autoencoder: project a centred frame on ``k`` components and back.

    The components are orthonormal, so the squared error of the reconstruction is the
    squared length of the frame minus that of its projection.
    """

    model: PCAModel
    means: list[float]

    def errors(self, frames: DataFrame, name: str = "error") -> DataFrame:
        means = F.array(*[F.lit(m) for m in self.means])
        centred = F.zip_with(flatten_features("features"), means, lambda x, m: x - m)
        projected = self.model.transform(
            frames.withColumn("_x", centred).withColumn("_v", array_to_vector("_x"))
        )
        lost = squared_norm("_x") - squared_norm(vector_to_array("_p"))
        return projected.withColumn(
            name, F.greatest(lost, F.lit(0.0)) / F.lit(float(len(self.means)))
        ).drop("_x", "_v", "_p")


def fit_reconstruction(train: DataFrame, k: int = 16) -> Reconstruction:
    """Fit on the training frames; only means and a features x features matrix are gathered."""
    vectors = train.select(feature_vector("features").alias("_v"))
    means = vectors.select(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray().tolist()
    centre = F.array(*[F.lit(m) for m in means])
    centred = train.select(
        array_to_vector(
            F.zip_with(flatten_features("features"), centre, lambda x, m: x - m)
        ).alias("_v")
    )
    model = PCA(k=min(k, len(means)), inputCol="_v", outputCol="_p").fit(centred)
    return Reconstruction(model, means)


def error_threshold(train: DataFrame, error: str = "error", q: float = 0.99) -> DataFrame:
    """One row: the exact, interpolated ``q`` quantile of the training errors."""
    return exact_quantiles(train, [], error, {"threshold": q})


def flag_anomalies(
    train: DataFrame, test: DataFrame, error: str = "error", q: float = 0.99
) -> DataFrame:
    """Test rows with ``anomaly``: error above the training threshold."""
    limit = error_threshold(train, error, q).scalar()
    return test.withColumn("threshold", limit).withColumn(
        "anomaly", F.col(error) > F.col("threshold")
    )


def anomaly_summary(train: DataFrame, flagged: DataFrame, error: str = "error") -> DataFrame:
    """One row: mean errors, the threshold and how many test rows exceed it."""
    train_mean = train.agg(F.avg(error).alias("m")).scalar()
    return flagged.agg(
        F.max("threshold").alias("threshold"),
        F.avg(error).alias("test_mean"),
        F.count_if("anomaly").alias("anomalies"),
        F.count(F.lit(1)).alias("test_rows"),
    ).select(train_mean.alias("train_mean"), "threshold", "test_mean", "anomalies", "test_rows")


def first_flagged(flagged: DataFrame, n: int = 25, error: str = "error") -> DataFrame:
    """The first ``n`` anomalies in sequence order."""
    return (
        flagged.where("anomaly")
        .orderBy("position")
        .limit(n)
        .select("position", "machine", "start", "end", error)
    )


def inject_scenarios(
    frames: DataFrame,
    scenarios: dict[str, dict[str, float]] = FAILURE_SCENARIOS,
    cols: Sequence[str] = METRIC_COLUMNS,
) -> DataFrame:
    """One row per frame and scenario, with the scenario's metrics overwritten in all steps."""

    def overwritten(levels: dict[str, float]) -> Column:
        def step(row: Column) -> Column:
            return F.array(
                *[F.lit(float(levels[c])) if c in levels else row[i] for i, c in enumerate(cols)]
            )

        return F.transform("features", step)

    variants = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), overwritten(levels).alias("features"))
            for name, levels in scenarios.items()
        ]
    )
    rest = [c for c in frames.columns if c != "features"]
    return frames.select(*rest, F.inline(variants))


def injection_base(split_frames: DataFrame) -> DataFrame:
    """The test frames, or the training frames when there is no test frame."""
    has_test = split_frames.agg(F.count_if(F.col("split") == "test").alias("n")).scalar()
    return (
        split_frames.withColumn("_tests", has_test)
        .where((F.col("split") == "test") | (F.col("_tests") == 0))
        .drop("_tests")
    )


def detection_rates(
    scored: DataFrame, threshold: float | Column, error: str = "error"
) -> DataFrame:
    """Flagged and total frames per injected scenario."""
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    return (
        scored.withColumn("_limit", limit)
        .groupBy("scenario")
        .agg(
            F.count_if(F.col(error) > F.col("_limit")).alias("flagged"),
            F.count(F.lit(1)).alias("total"),
        )
    )
