"""The tables behind the exploratory charts of the server-metrics data."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import METRIC_COLUMNS
from fleetpulse.operators.ordered import counted_quantiles
from fleetpulse.session import stage


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def mean_by_machine(df: DataFrame, metric: str) -> DataFrame:
    return mean_by(df, ["machine"], [metric])


def cpu_gpu_means(df: DataFrame) -> DataFrame:
    return mean_by(df, ["machine"], ["cpu_usage", "gpu_wrk_util"])


def metric_over_time(df: DataFrame, metric: str) -> DataFrame:
    return mean_by(df, ["timestamp", "machine"], [metric])


def sum_by(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Totals per key; a group without any value totals 0."""
    return df.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])


def scatter_points(
    df: DataFrame, x: str = "cpu_usage", y: str = "gpu_wrk_util", key: str = "machine"
) -> DataFrame:
    return df.select(key, x, y)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins over the value range; the last bin includes its end."""
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_x"))
    edges = values.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    row = edges.select(F.struct("lo", "hi").alias("_e")).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.lit(bins)
    placed = F.least(F.floor((F.col("_x") - F.col("_e.lo")) / width).cast("int"), F.lit(bins - 1))
    counts = values.withColumn("_e", row).groupBy(placed.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    all_bins = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.col("lo") + F.col("bin") * step).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def _value_counts(df: DataFrame, col: str, key: str) -> DataFrame:
    """Rows per key and value, written once: quartiles, extremes and outliers all follow."""
    counts = df.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.count(F.lit(1)).alias("_n"))
    return stage(counts, "value-counts")


def _fences(counts: DataFrame, col: str, key: str) -> DataFrame:
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = counted_quantiles(counts, [key], col, "_n", probs)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})


def box_stats(df: DataFrame, col: str = "cpu_usage", key: str = "machine") -> DataFrame:
    """Quartiles, whiskers (the extreme values within 1.5 IQR) and the outlier count per key."""
    counts = _value_counts(df, col, key)
    fenced = counts.join(_fences(counts, col, key), key)
    inside = F.col(col).between(F.col("_low"), F.col("_high"))
    grouped = fenced.groupBy(key).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(col))).alias("_lo"),
        F.max(F.when(inside, F.col(col))).alias("_hi"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
    )
    # A whisker never ends inside the box.
    return grouped.select(
        key,
        "q1",
        "median",
        "q3",
        F.least(F.coalesce("_lo", "q1"), "q1").alias("whisker_low"),
        F.greatest(F.coalesce("_hi", "q3"), "q3").alias("whisker_high"),
        "outliers",
    )


def box_outliers(df: DataFrame, col: str = "cpu_usage", key: str = "machine") -> DataFrame:
    """The rows beyond the whiskers; counts of values give the fences only."""
    fences = _fences(_value_counts(df, col, key), col, key).select(key, "_low", "_high")
    fenced = df.select(key, col).join(fences, key)
    return fenced.where(~F.col(col).between(F.col("_low"), F.col("_high"))).select(key, col)


def violin_stats(df: DataFrame, col: str = "cpu_usage", key: str = "machine") -> DataFrame:
    """Minimum, maximum, mean and median per key."""
    counts = _value_counts(df, col, key)
    medians = counted_quantiles(counts, [key], col, "_n", {"median": 0.5})
    spread = counts.groupBy(key).agg(
        F.sum("_n").alias("n"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        (F.sum(F.col(col) * F.col("_n")) / F.sum("_n")).alias("mean"),
    )
    return spread.join(medians, key)


def violin_density(
    df: DataFrame, col: str = "cpu_usage", key: str = "machine", grid: int = 100
) -> DataFrame:
    """Gaussian kernel density of each key on ``grid`` points between its extremes.

    The bandwidth follows Scott's rule. Equal values are counted first; each distinct
    value then adds to the grid points map-side, so only ``grid`` partial sums per key
    and task are shuffled. Keys without spread have no density.
    """
    counted = (
        df.where(F.col(col).isNotNull())
        .groupBy(key, F.col(col).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    shape = (
        df.where(F.col(col).isNotNull())
        .groupBy(key)
        .agg(
            F.min(col).alias("_lo"),
            F.max(col).alias("_hi"),
            F.count(F.lit(1)).cast("double").alias("_total"),
            F.stddev_samp(col).alias("_sd"),
        )
        .where(F.col("_sd") > 0)
        .withColumn("_h", F.col("_sd") * F.pow("_total", F.lit(-0.2)))
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(grid - 1)
    at = F.col("_lo") + F.col("point") * step
    z = (at - F.col("_x")) / F.col("_h")
    kernel = F.exp(-0.5 * z * z) * F.col("_n")
    return (
        counted.join(shape, key)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .groupBy(key, "point")
        .agg(
            F.first(at).alias("x"),
            F.sum(kernel).alias("_mass"),
            F.first(F.col("_total") * F.col("_h")).alias("_scale"),
        )
        .select(
            key,
            "point",
            "x",
            (F.col("_mass") / (F.col("_scale") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"),
        )
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str] = METRIC_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair of columns, as (x, y, r) rows.

    Columns that hold a value in every row, as all do once imputed, share one Gramian pass.
    Pairs with a column of scattered nulls use the rows where both are present. Pairs with a
    constant or empty column have no correlation.
    """
    spread = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{i}")
            for i, c in enumerate(cols)
        ],
    ).first()
    facts = {c: spread[f"_{i}"] for i, c in enumerate(cols)}
    varied = [c for c in cols if facts[c].n > 1 and facts[c].lo < facts[c].hi]
    whole = [c for c in varied if facts[c].n == spread.rows]
    known: dict[tuple[str, str], Column] = {}
    if whole:
        vectors = VectorAssembler(inputCols=whole, outputCol="_v").transform(df.select(*whole))
        matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
        for i, x in enumerate(whole):
            for j, y in enumerate(whole):
                known[x, y] = F.lit(1.0 if i == j else float(matrix[i, j]))
    pairs = [
        (x, y)
        for x, y in combinations_with_replacement(cols, 2)
        if x in varied and y in varied and (x, y) not in known
    ]

    def moments(x: str, y: str) -> Column:
        # try_divide, since corr() itself fails on a constant column.
        a = F.when(F.col(y).isNotNull(), F.col(x))
        b = F.when(F.col(x).isNotNull(), F.col(y))
        return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))

    for i, (x, y) in enumerate(pairs):
        known[x, y] = known[y, x] = F.lit(1.0) if x == y else F.col(f"_r{i}")
    row = df.agg(F.count(F.lit(1)), *[moments(*pair).alias(f"_r{i}") for i, pair in enumerate(pairs)])
    nothing = F.lit(None).cast("double")
    entries = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), known.get((x, y), nothing).alias("r"))
        for x in cols
        for y in cols
    ]
    # Without pairs of their own the rows are not read again.
    source = row if pairs else df.sparkSession.range(1)
    return source.select(F.inline(F.array(*entries)))
