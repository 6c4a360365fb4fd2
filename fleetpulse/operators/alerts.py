"""Alert evaluation, confirmation, recovery and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetpulse.operators.ordered import carry_last, grid_slices, own_rows
from fleetpulse.session import stage

_STEP = "_step"


def evaluate_alerts(
    predictions: DataFrame,
    window: str = "2 minutes",
    slide: str = "1 minute",
    level: float = 0.8,
    time: str = "window_end",
) -> DataFrame:
    """Highest score per machine over each look-back window, and whether it exceeds ``level``."""
    spans = F.window(F.col(time), window, slide)
    return (
        predictions.groupBy("machine_id", spans.alias("_w"))
        .agg(F.max("p_fail_5m").alias("max_score"))
        .select(
            "machine_id",
            F.col("_w.end").alias("eval_at"),
            "max_score",
            (F.col("max_score") > F.lit(float(level))).alias("breached"),
        )
    )


def _in_a_row(df: DataFrame, slide_seconds: int, n: int, holds: Column, name: str) -> DataFrame:
    """True where ``holds`` at ``n`` evaluations in a row, with none missing between them."""
    framed, frame = grid_slices(df, ["machine_id"], "eval_at", slide_seconds, back=n - 1)
    by_step = W.partitionBy("machine_id", "_slice").orderBy(_STEP).rangeBetween(-(n - 1), 0)
    stepped = framed.withColumn(
        _STEP, F.floor(F.unix_seconds("eval_at") / F.lit(slide_seconds)).cast("bigint")
    )
    return own_rows(
        stepped.withColumn(name, F.count(F.when(holds, F.lit(1))).over(by_step) == n)
    ).drop(_STEP)


def confirm(evaluations: DataFrame, slide_seconds: int = 60, n: int = 2) -> DataFrame:
    """Add ``confirmed``: breached at ``n`` consecutive evaluations."""
    return _in_a_row(evaluations, slide_seconds, n, F.col("breached"), "confirmed")


def recover(confirmed: DataFrame, slide_seconds: int = 60, n: int = 3) -> DataFrame:
    """Add ``recovered``: after an alert, the ``n``-th consecutive evaluation below the level."""
    calm = _in_a_row(confirmed, slide_seconds, n, ~F.col("breached"), "_calm")
    events = calm.withColumn("_event", F.when(F.col("confirmed"), 1).when(F.col("_calm"), 0))
    # Evaluations sit on the slide grid: a slice of 4096 steps is a bounded window.
    known = carry_last(
        events, ["machine_id"], "eval_at", "_event", "_before", span=slide_seconds * 4096
    )
    return known.withColumn(
        "recovered", F.col("_calm") & (F.coalesce("_before", F.lit(0)) == 1)
    ).drop("_calm", "_event", "_before")


#: Slices, or blocks of them, that meet in one row.
FAN = 1024


def _composed(origin: Column, width: Column, period: Column) -> Column:
    """One list of answers for a sorted run of slices, ``_line``.

    An answer (first, last) reads: a run entered so that ``first`` fires first, fires last at
    ``last``. Only firings that can come first after an entry before the run are kept: those
    inside its first ``period``, and one more.
    """
    reach = origin + F.col("_line")[0]["_s"] * width + period

    def after(last: Column, answers: Column) -> Column:
        open_ = F.filter(answers, lambda a: a["first"] >= last + period)
        return F.coalesce(F.get(open_, F.lit(0))["last"], last)

    def joined(known: Column, piece: Column) -> Column:
        more = F.size(F.filter(piece["answers"], lambda a: a["first"] < reach)) + 1
        added = F.when(
            ~F.exists(known, lambda a: a["first"] >= reach),
            F.slice(piece["answers"], F.lit(1), more),
        ).otherwise(F.slice(piece["answers"], F.lit(1), F.lit(0)))
        moved = F.transform(
            known,
            lambda a: F.struct(
                a["first"].alias("first"), after(a["last"], piece["answers"]).alias("last")
            ),
        )
        return F.concat(moved, added)

    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return F.aggregate("_line", none, joined)


def _entries(period: Column) -> Column:
    """The last firing before each slice of a sorted ``_line`` that is entered at ``_entry``."""

    def follow(state: Column, piece: Column) -> Column:
        last = state["last"]
        open_ = F.filter(
            piece["answers"], lambda a: last.isNull() | (a["first"] >= last + period)
        )
        return F.struct(
            F.coalesce(F.get(open_, F.lit(0))["last"], last).alias("last"),
            F.array_append(
                state["entries"], F.struct(piece["_s"].alias("_s"), last.alias("_entry"))
            ).alias("entries"),
        )

    start = F.struct(
        F.col("_entry").alias("last"),
        F.array().cast("array<struct<_s:bigint,_entry:bigint>>").alias("entries"),
    )
    return F.aggregate("_line", start, follow, lambda state: state["entries"])


def _slice_entries(
    answers: DataFrame, origin: Column, width: Column, period: Column, fan: int, count: int
) -> DataFrame:
    """(machine_id, _s, _entry) for slices (machine_id, _s, answers), numbered below ``count``.

    ``fan`` neighbouring slices compose into a block, blocks into larger ones, until one is
    left a machine; then entries are handed down the same way. No row holds more than ``fan``
    of them, however long a machine's history is.
    """
    grouped = answers.groupBy(
        "machine_id", F.floor(F.col("_s") / fan).cast("bigint").alias("_block")
    ).agg(F.sort_array(F.collect_list(F.struct("_s", "answers"))).alias("_line"))
    if count <= fan:
        entered = grouped.withColumn("_entry", F.lit(None).cast("bigint"))
    else:
        grouped = stage(grouped, "alert-blocks")
        larger = grouped.select(
            "machine_id",
            F.col("_block").alias("_s"),
            _composed(origin, width, period).alias("answers"),
        )
        above = _slice_entries(larger, origin, width * fan, period, fan, -(-count // fan))
        entered = grouped.join(
            above.withColumnRenamed("_s", "_block"), ["machine_id", "_block"]
        )
    return entered.select("machine_id", F.inline(_entries(period)))


def suppress(
    alerts: DataFrame, minutes: float = 10, at: str = "eval_at", span: int = 86400, fan: int = FAN
) -> DataFrame:
    """Add ``fired``: an alert fires unless one fired in the ``minutes`` before it.

    The rule is sequential, yet a slice of time only needs to know when the last alert
    before it fired. Each slice therefore first answers "if my first firing is here,
    when is my last one?" for the few alerts that can come first. Answers of neighbouring
    slices compose, level by level, and hand every slice its starting point, after which the
    slices replay independently. A slice holds at most ``span`` seconds of one machine's
    alerts, a row at most ``fan`` slices' answers.
    """
    quiet = round(minutes * 60_000_000)
    size = max(span * 1_000_000, quiet)
    period, width = (F.lit(n).cast("bigint") for n in (quiet, size))
    times = alerts.select("machine_id", F.unix_micros(at).alias("_t")).distinct()
    sliced = times.withColumn("_s", F.floor(F.col("_t") / width).cast("bigint"))
    slices = stage(
        sliced.groupBy("machine_id", "_s").agg(F.sort_array(F.collect_list("_t")).alias("_ts")),
        "alert-slices",
    )
    ends = slices.agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).first()
    first, count = (ends.lo, ends.hi - ends.lo + 1) if ends.lo is not None else (0, 1)
    slices = slices.withColumn("_s", F.col("_s") - first)
    origin = F.lit(first * size).cast("bigint")

    def last_firing(first: Column) -> Column:
        return F.aggregate("_ts", first, lambda last, t: F.when(t >= last + period, t).otherwise(last))

    early = F.size(F.filter("_ts", lambda t: t < origin + F.col("_s") * width + period))
    answers = slices.withColumn("_heads", F.slice("_ts", F.lit(1), early + 1)).select(
        "machine_id",
        "_s",
        F.transform(
            "_heads", lambda t: F.struct(t.alias("first"), last_firing(t).alias("last"))
        ).alias("answers"),
    )
    entries = _slice_entries(answers, origin, width, period, fan, count)

    def replay(state: Column, t: Column) -> Column:
        fires = state["last"].isNull() | (t >= state["last"] + period)
        return F.struct(
            F.when(fires, t).otherwise(state["last"]).alias("last"),
            F.when(fires, F.array_append(state["fired"], t)).otherwise(state["fired"]).alias("fired"),
        )

    begin = F.struct(
        F.col("_entry").alias("last"), F.array().cast("array<bigint>").alias("fired")
    )
    fired = (
        slices.join(entries, ["machine_id", "_s"])
        .select("machine_id", F.explode(F.aggregate("_ts", begin, replay, lambda s: s["fired"])).alias("_t"))
        .select("machine_id", F.timestamp_micros("_t").alias(at), F.lit(True).alias("fired"))
    )
    return alerts.join(fired, ["machine_id", at], "left").withColumn(
        "fired", F.coalesce("fired", F.lit(False))
    )
