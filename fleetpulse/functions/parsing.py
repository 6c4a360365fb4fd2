"""Column expressions that turn text into typed values and measure completeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text forms of a metrics timestamp. The logger writes
# day-month-year with two-digit years; the exploratory loader also takes four-digit
# years, slashes, missing seconds or times, and ISO order.
LOG_SHAPE = r"^\d{1,2}-\d{1,2}-\d{2} \d{1,2}:\d{1,2}:\d{1,2}$"
DAY_FIRST_SHAPE = r"^\d{1,2}-\d{1,2}-(\d{2}|\d{4})( \d{1,2}:\d{1,2}(:\d{1,2})?)?$"
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]|$)"
DAY_FIRST_FORMAT = "d-M-yyyy[ H:m[:s]]"


def _four_digit_year(text: Column) -> Column:
    """Two-digit years from 69 on belong to the last century."""
    last_century = F.regexp_replace(text, r"^(\d{1,2}-\d{1,2}-)(69|[7-9]\d)(?=\D|$)", "$119$2")
    return F.regexp_replace(last_century, r"^(\d{1,2}-\d{1,2}-)(\d{2})(?=\D|$)", "$120$2")


def parse_ts(text: str | Column, day_first: bool = False, epoch_first: bool = True) -> Column:
    """Timestamp from epoch seconds (optional, tried first) or from the logger's format;
    with ``day_first`` from its relatives and ISO text too.

    The shape of the text decides whether parsing is worth trying: a failed parse costs
    far more than a pattern match.
    """
    column = F.trim(F.col(text) if isinstance(text, str) else text)
    chain = F
    if epoch_first:
        seconds = column.try_cast("double")
        micros = F.round(seconds * 1e6).try_cast("bigint")
        chain = chain.when(seconds.isNotNull(), F.timestamp_micros(micros))
    dashed = F.translate(column, "/", "-") if day_first else column
    chain = chain.when(
        dashed.rlike(DAY_FIRST_SHAPE if day_first else LOG_SHAPE),
        F.try_to_timestamp(_four_digit_year(dashed), F.lit(DAY_FIRST_FORMAT)),
    )
    if day_first:
        chain = chain.when(column.rlike(ISO_SHAPE), column.try_cast("timestamp"))
    return chain.otherwise(F.lit(None).cast("timestamp"))


def no_nan(number: str | Column) -> Column:
    column = F.col(number) if isinstance(number, str) else number
    return F.when(~F.isnan(column), column)


def to_number(text: str | Column) -> Column:
    """Double, or null where the text is not a number."""
    column = F.col(text) if isinstance(text, str) else text
    return no_nan(F.trim(column.cast("string")).try_cast("double"))


def machine_key(machine: str | Column) -> Column:
    """Trimmed machine name; absent and blank names become ``unknown``."""
    column = F.trim(F.col(machine) if isinstance(machine, str) else machine)
    return F.when(F.coalesce(column, F.lit("")) == "", "unknown").otherwise(column)


def expected_rows_per_bucket(tick_seconds: float = 5, bucket_seconds: float = 30) -> int:
    """Events one machine should send per bucket; halves round to the even number."""
    return max(1, round(bucket_seconds / tick_seconds))


def missing_ratio(rows: str | Column, expected: int, clip: bool = True) -> Column:
    """Share of expected events that did not arrive; unclipped it may be negative."""
    count = F.col(rows) if isinstance(rows, str) else rows
    if clip:
        return F.lit(1.0) - F.least(count, F.lit(expected)) / F.lit(float(expected))
    return (F.lit(float(expected)) - count) / F.lit(float(expected))


def bucket_start(time: str | Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``time``."""
    column = F.col(time) if isinstance(time, str) else time
    return F.timestamp_seconds(F.floor(F.unix_seconds(column) / F.lit(seconds)) * F.lit(seconds))
