"""Alert suppression over many slices against the plain sequential rule."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators.alerts import suppress
from tests.helpers import T0


def plain(rows, minutes):
    fired, last = set(), {}
    for machine, t in sorted(rows):
        if machine not in last or t >= last[machine] + minutes * 60:
            fired.add((machine, t))
            last[machine] = t
    return fired


def frame(spark, rows):
    made = [(m, T0 + timedelta(seconds=t)) for m, t in rows]
    return spark.createDataFrame(made, "machine_id string, eval_at timestamp")


def fired(df):
    rows = df.where("fired").select("machine_id", F.unix_seconds("eval_at").alias("t")).collect()
    return {(r.machine_id, r.t - int(T0.timestamp())) for r in rows}


@pytest.mark.parametrize(("fan", "minutes", "span"), [(2, 10, 900), (3, 17, 600), (4, 45, 300), (1024, 10, 900)])
def test_levels_of_slices_equal_the_plain_rule(spark, fan, minutes, span):
    pick, rows = random.Random(fan * 100 + minutes), set()
    for machine, n, reach in (("busy", 600, 90_000), ("sparse", 60, 900_000), ("one", 1, 10), ("old", 40, 80_000)):
        shift = -5_000_000 if machine == "old" else 0
        rows |= {(machine, shift + 60 * pick.randrange(reach // 60 + 1)) for _ in range(n)}
    rows = sorted(rows)
    found = suppress(frame(spark, rows), minutes, span=span, fan=fan)
    assert fired(found) == plain(rows, minutes)
    assert found.count() == len(rows)


def test_a_long_run_of_alerts_crosses_every_level(spark):
    rows = [("a", 60 * i) for i in range(3000)]
    for minutes in (7, 61):
        assert fired(suppress(frame(spark, rows), minutes, span=600, fan=4)) == plain(rows, minutes)


def test_no_alerts(spark):
    assert suppress(frame(spark, [])).collect() == []


def test_no_row_holds_more_than_its_share_of_slices(spark, monkeypatch):
    from fleetpulse.operators import alerts

    held, write = [], alerts.stage

    def spied(df, label):
        written = write(df, label)
        if label == "alert-blocks":
            held.append(written.agg(F.max(F.size("_line")).alias("n")).first().n)
            most = F.max(F.array_max(F.transform("_line", lambda p: F.size(p["answers"]))))
            held.append(written.agg(most.alias("n")).first().n)
        return written

    monkeypatch.setattr(alerts, "stage", spied)
    rows = [("a", 60 * i) for i in range(4000)]
    assert fired(suppress(frame(spark, rows), 10, span=600, fan=8)) == plain(rows, 10)
    assert len(held) >= 4 and max(held[::2]) <= 8 and max(held[1::2]) <= 11
