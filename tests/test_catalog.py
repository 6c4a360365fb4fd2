"""Registered queries against their SQL twins, in DuckDB, on the smallest tables.

A few queries run by default; set ``ALL_QUERIES=1`` to run every one.
"""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from fleetpulse.catalog import load_catalog
from fleetpulse.catalog.registry import ORACLES, QUERIES
from fleetpulse.session import shared_dir

load_catalog()
QUICK = [
    "a3_decoded_events",
    "b1_checked_events",
    "c2_incidents",
    "d2_stream_buckets",
    "d13_cpu_box",
    "d15_correlations",
    "d26_evaluation",
    "e5_sequences",
    "e9_positional_split",
    "e12_recoveries",
    "e13_fired_alerts",
    "g4_refined_windows",
    "g5_late_events",
    "g7_restarted_windows",
    "g8_streamed_alerts",
    "h3_labelled_model_rows",
    "h5_batch_scores",
    "j1_failure_labels",
]


def test_every_query_has_a_twin():
    assert ORACLES.keys() == QUERIES.keys() <= contract.queries().keys()
    assert ORACLES.keys() <= contract.oracle_sql().keys()


def test_entry_is_lazy_and_stable(spark):
    df = contract.entry(spark)
    assert df.columns == QUERIES["h3_labelled_model_rows"](spark, contract._SMOKE_DIR).columns
    assert df.limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = Counter(repr(tuple(row)) for row in df.select(*sorted(df.columns)).collect())
    engine = duckdb.connect()
    engine.sql("SET TimeZone = 'UTC'")
    engine.sql(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    result = engine.sql(ORACLES[name])
    places = sorted(range(len(result.columns)), key=lambda i: result.columns[i])
    assert [result.columns[i] for i in places] == sorted(df.columns)
    expected = Counter(repr(tuple(row[i] for i in places)) for row in result.fetchall())
    assert found == expected


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class _Session:
    def __init__(self, master, named=None):
        self.sparkContext = _Context(master)
        self.conf = type("Conf", (), {"get": lambda _, key, default: named or default})()


def test_shared_folder_comes_from_the_session():
    assert shared_dir(_Session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("yarn"))
    local = _Session("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.sparkContext.folder
