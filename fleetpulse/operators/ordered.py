"""Ordered work per key that never needs a whole key in one task.

Window functions over ``partitionBy(machine)`` would put a dominant machine into one
task. The helpers here cut each key's time line into slices of bounded size, carry the
few rows (or totals) a slice needs from its neighbours, and leave results exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.session import stage

SLICE_ROWS = 4096
_SLICE = "_slice"
_HOME = "_home"
_RANGE = "_range"


def grid_index(time: str | Column, step: int) -> Column:
    """Number of the ``step``-second cell that holds ``time``, counted from the epoch."""
    column = F.col(time) if isinstance(time, str) else time
    return F.floor(F.unix_seconds(column) / F.lit(step)).cast("bigint")


def _spread(df: DataFrame, index: Column, back: int, rows: int) -> DataFrame:
    home = F.floor(index / F.lit(rows)).cast("bigint")
    opens_next = F.pmod(index, F.lit(rows)) >= rows - back
    return df.withColumn(_HOME, home).withColumn(
        _SLICE,
        F.explode(F.array_compact(F.array(F.col(_HOME), F.when(opens_next, F.col(_HOME) + 1)))),
    )


def grid_slices(
    df: DataFrame, keys: Sequence[str], time: str, step: int, back: int, rows: int = SLICE_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Slices of a regular time grid, each opened by the ``back`` grid cells before it.

    One slice holds at most ``rows + back`` grid cells of one key. Frames that look at
    most ``back`` cells backwards are exact on the rows kept by :func:`own_rows`.
    """
    rows = max(rows, back)
    framed = _spread(df, grid_index(time, step), back, rows)
    return framed, W.partitionBy(*keys, _SLICE).orderBy(time)


def with_position(
    df: DataFrame, keys: Sequence[str], time: str, name: str = "_position", ties: Sequence[str] = ()
) -> DataFrame:
    """Exact 1-based position of each row within its key, in the order of time and ``ties``.

    Rows are cut into ranges of (key, time, ties) that hold similar row counts, numbered
    inside each range and shifted by the sizes of their key's earlier ranges. A key or an hour
    with most of the rows is therefore cut like any other stretch; only rows that are equal in
    key, time and ties stay together. A key's list of sizes is as long as its ranges.
    """
    ordering = [*keys, time, *ties]
    ranged = value_ranges(df, ordering, ordering, per_task=8, oversample=32)
    sizes = ranged.groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*keys).orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)],
        F.col(_RANGE).alias("_of"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"),
    )
    inside = F.row_number().over(W.partitionBy(*keys, _RANGE).orderBy(time, *ties))
    # Null keys have positions too.
    same = F.col(_RANGE) == F.col("_of")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return (
        ranged.withColumn(name, inside)
        .join(shifts, same)
        .withColumn(name, F.col(name) + F.col("_shift"))
        .drop(_RANGE, "_of", "_shift", *[f"_key{i}" for i in range(len(keys))])
    )


def position_slices(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    back: int,
    rows: int = SLICE_ROWS,
) -> tuple[DataFrame, WindowSpec]:
    """Like :func:`grid_slices` for rows at irregular times: frames count rows, not cells."""
    rows = max(rows, back)
    placed = with_position(df, keys, time)
    framed = _spread(placed, F.col("_position"), back, rows)
    return framed, W.partitionBy(*keys, _SLICE).orderBy("_position")


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the neighbour rows that only served as history."""
    return df.where(F.col(_SLICE) == F.col(_HOME)).drop(_SLICE, _HOME, "_position")


def carry_last(
    df: DataFrame, keys: Sequence[str], time: str, value: str, name: str, span: int = 86400
) -> DataFrame:
    """Latest non-null ``value`` strictly before each row of its key."""
    sliced = df.withColumn(_SLICE, grid_index(time, span))
    closing = (
        sliced.where(F.col(value).isNotNull())
        .groupBy(*keys, _SLICE)
        .agg(F.max_by(value, time).alias("_closing"))
    )
    slices = sliced.groupBy(*keys, _SLICE).agg(F.lit(1).alias("_seen"))
    earlier = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = slices.join(closing, [*keys, _SLICE], "left").select(
        *keys, _SLICE, F.last("_closing", ignorenulls=True).over(earlier).alias("_carried")
    )
    before = (
        W.partitionBy(*keys, _SLICE).orderBy(time).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        sliced.withColumn(name, F.last(value, ignorenulls=True).over(before))
        .join(carried, [*keys, _SLICE])
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop(_SLICE, "_carried")
    )


def range_count(df: DataFrame) -> int:
    """How many value ranges to cut: one per shuffle partition."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 8)


def value_ranges(
    df: DataFrame,
    unique: Sequence[str],
    order: Sequence[str],
    per_task: int = 1,
    oversample: int = 8,
) -> DataFrame:
    """Number each row by the value range it falls into; ranges hold similar row counts.

    The cut points come from the rows with the smallest hash of their ``unique``
    columns. That choice is a function of the data alone, so a retried task sees the
    same ranges, and only a bounded list of cut points leaves the executors. The cut
    points only balance the work: every row is kept. More candidates a cut (``oversample``)
    make sizes more even, more ranges (``per_task``) even out what meets in one task.
    """
    ranges = range_count(df) * per_task
    probe = F.struct(*order)
    cuts = (
        df.select(probe.alias("_probe"), F.xxhash64(*unique).alias("_hash"))
        .orderBy("_hash", "_probe")
        .limit(ranges * oversample)
        .agg(F.sort_array(F.collect_list("_probe")).alias("_cuts"))
        .select(F.filter("_cuts", lambda _, i: i % oversample == oversample - 1).alias("_fine"))
    )
    # Searched in two levels: the last cut of each block of cuts, then the cuts of one block.
    block = max(1, isqrt(ranges))
    cuts = cuts.select(
        F.struct(
            "_fine",
            F.filter("_fine", lambda _, i: i % block == block - 1).alias("_coarse"),
        ).alias("_cuts")
    )
    passed = F.size(F.filter("_cuts._coarse", lambda cut: cut <= probe)) * block
    within = F.slice("_cuts._fine", passed + 1, F.lit(block))
    number = passed + F.size(F.filter(within, lambda cut: cut <= probe))
    # Never null, so that no null check on it is inferred and pushed below an aggregate.
    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn(_RANGE, F.coalesce(number, F.lit(0)))
        .drop("_cuts")
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]
) -> DataFrame:
    """Inclusive running sums and grand totals of ``sums`` per key in ``order``.

    ``df`` must be unique on ``keys + order`` (pre-aggregate first) and is read three
    times, so pass a written table when it is the result of heavy work. Each value range
    is summed on its own and shifted by the totals of the ranges before it, so neither
    a dominant key nor the un-keyed case needs a single-task sort. Adds ``cum_<c>`` and
    ``total_<c>`` for every summed column.
    """
    ranged = value_ranges(df, [*keys, *order], order)
    totals = ranged.groupBy(*keys, _RANGE).agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        *keys,
        _RANGE,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_shift_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = (
        W.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in sums]).join(
        shifts, [*keys, _RANGE]
    )
    return summed.withColumns(
        {f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_shift_{c}") for c in sums}
    ).drop(_RANGE, *[f"_shift_{c}" for c in sums])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated exact quantiles of ``value`` per key, one column per name.

    Equal values are counted map-side before anything is shuffled. The counts are
    written, so that the input is read once.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted_quantiles(stage(counted, "value-counts"), keys, value, "_n", probs)


def counted_quantiles(
    counted: DataFrame, keys: Sequence[str], value: str, count: str, probs: dict[str, float]
) -> DataFrame:
    """The same from distinct values and their counts; null values are left out.

    Values are ranked with :func:`running_sums`; each quantile is then a pair of
    conditional minima, which combine map-side.
    """
    present = counted.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_value"), F.col(count).alias("_n")
    )
    ranked = running_sums(present, keys, ["_value"], ["_n"])

    def place(prob: float) -> Column:
        return (F.col("total__n") - 1) * F.lit(float(prob))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("cum__n") > rank, F.col("_value")))

    picked = ranked.groupBy(*keys).agg(
        *[at(F.floor(place(p))).alias(f"_lo_{name}") for name, p in probs.items()],
        *[at(F.ceil(place(p))).alias(f"_hi_{name}") for name, p in probs.items()],
        *[F.max(place(p) - F.floor(place(p))).alias(f"_part_{name}") for name, p in probs.items()],
    )
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_part_{name}")
            ).alias(name)
            for name in probs
        ],
    )
