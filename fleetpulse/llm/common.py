"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so extra columns never clash."""
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in names.items()])


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(
    df: DataFrame, schema: str, rows_of: Callable[[dict[str, list]], dict[str, list]]
) -> DataFrame:
    """``mapInArrow`` over plain column lists: one call per Arrow batch, one result row list."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = rows_of(batch.to_pydict())
                arrays = [pa.array(made[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def summed(
    df: DataFrame,
    partials: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]],
    dtype=np.float64,
    at_once: int = 32,
) -> np.ndarray | None:
    """The sum of the vectors that ``partials`` makes of each partition; None without any.

    Each task adds up its own. The driver adds up those of at most ``at_once`` tasks; more are
    added by tasks before, in groups.
    """

    def total(vectors: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held = None
        for vector in vectors:
            held = vector.astype(dtype) if held is None else held + vector
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["part"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(partials(batches))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(v.as_buffer(), dtype) for b in batches for v in b.column("part"))

    found, parts = df.mapInArrow(first, "part binary"), df.rdd.getNumPartitions()
    while parts > at_once:
        parts = isqrt(parts)
        found = found.repartition(parts).mapInArrow(again, "part binary")
    held = [np.frombuffer(row.part, dtype) for row in found.collect()]
    return np.sum(held, axis=0) if held else None


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class Cache(dict):
    """A bounded memo of ``compute``: two generations, so frequent keys stay cached.

    The values depend on the keys alone; the bound limits memory, never results.
    """

    def __init__(self, compute: Callable, limit: int = 250_000):
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._limit:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteMemo:
    """Packed results by key in two generations, bounded in bytes; long keys are not kept."""

    #: Bytes of an entry besides its key and value, and of the longest key kept.
    ENTRY, LONGEST = 160, 256

    def __init__(self, limit: int):
        self._limit, self._used = limit, 0
        self.new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def older(self, key: bytes) -> bytes | None:
        """The result of a key that ``new`` lacks, which then holds it again."""
        value = self._old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key: bytes, value: bytes) -> None:
        if len(key) > self.LONGEST:
            return
        self._used += len(key) + len(value) + self.ENTRY
        if self._used > self._limit:
            self._old, self.new, self._used = self.new, {}, 0
        self.new[key] = value


_PER_WORKER: dict = {}


def once_per_worker(key, make: Callable):
    """Build a costly helper once in each Python worker, not once in each task."""
    if key not in _PER_WORKER:
        _PER_WORKER[key] = make()
    return _PER_WORKER[key]
