"""Outliers are filtered rows, not rows made from counts."""

from fleetpulse.operators import explore


def test_no_task_builds_an_array_of_a_hot_value(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5] * 20] + [("a", 99.0)] * 7 + [("a", None)]
    rows += [("b", 1.0)] * 30 + [("b", -5.0)] * 3 + [(None, 99.0)]
    df = spark.createDataFrame(rows, "machine string, cpu_usage double").repartition(3)
    found = explore.box_outliers(df)
    assert found.columns == ["machine", "cpu_usage"]
    assert sorted(map(tuple, found.collect())) == [("a", 99.0)] * 7 + [("b", -5.0)] * 3
    assert "sequence(" not in found._jdf.queryExecution().toString()
