"""Positions within a key when one key and one hour hold nearly all rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fleetpulse.operators.ordered import position_slices, value_ranges, with_position
from tests.helpers import at


def skewed(spark, n=20_000):
    """Nine rows in ten on one machine inside one hour; the rest over machines and weeks."""
    pick = random.Random(8)
    rows = []
    for i in range(n):
        if i % 10:
            rows.append(("hot", at(pick.randrange(3600)), i))
        else:
            machine = None if i % 100 == 0 else f"m{i % 70}"
            rows.append((machine, None if i % 90 == 0 else at(pick.randrange(10**6)), i))
    return spark.createDataFrame(rows, "machine_id string, event_time timestamp, i long").repartition(5)


def test_positions_equal_a_plain_numbering(spark):
    rows = with_position(skewed(spark), ["machine_id"], "event_time", ties=["i"]).collect()
    assert len(rows) == 20_000
    seen = Counter()
    for r in sorted(rows, key=lambda r: (r.event_time is not None, r.event_time or at(0), r.i)):
        seen[r.machine_id] += 1
        assert r["_position"] == seen[r.machine_id]


def test_no_task_takes_twice_its_share(spark):
    ordering = ["machine_id", "event_time", "i"]
    ranged = value_ranges(skewed(spark), ordering, ordering, per_task=8, oversample=32)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 2 * 20_000 / 64
    dealt = ranged.repartition(8, "machine_id", "_range").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in dealt.collect()) <= 2 * 20_000 / 8


def test_the_plan_has_no_window_over_a_whole_machine_or_day(spark):
    df = skewed(spark, 100)
    plan = with_position(df, ["machine_id"], "event_time")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert windows and all("_range" in line for line in windows)


def test_slices_by_position_hold_bounded_rows(spark):
    framed, _ = position_slices(skewed(spark), ["machine_id"], "event_time", back=3, rows=500)
    sizes = framed.groupBy("machine_id", "_slice").count().collect()
    assert max(r["count"] for r in sizes) <= 503


def test_empty_and_single_rows(spark):
    df = skewed(spark, 1)
    assert [r["_position"] for r in with_position(df, ["machine_id"], "event_time").collect()] == [1]
    assert with_position(df.limit(0), ["machine_id"], "event_time").collect() == []
