"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated at random and kept as signs, with the correction factor that makes
inner products estimated from the signs unbiased, and from which their error is bounded. Sign
bits of further rotations make bucket keys. Two vectors are compared in the first bucket that
they share: the estimate and its bound tell whether the cosine has to be recomputed exactly.

Equal vectors form one class. The length of the keys follows the number of classes, and the
number of tables follows from the recall wanted at the threshold, so buckets of unrelated
vectors stay small at every size. A large bucket is compared in pairs of blocks, each a task's
work of bounded size, which puts out counts and local components, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as, map_rows
from fleetpulse.llm.components import component_roots
from fleetpulse.session import stage

COSINE = 0.95
#: Share of the pairs at exactly the threshold that meet in a bucket; nearer ones meet more often.
RECALL = 0.9995
#: An estimate is trusted within so many standard errors.
ERRORS = 5.0
#: Vectors of a block; two blocks are compared at once.
BLOCK = 1024
_CHUNK = 50_000
_GROUP = ["bucket", "low", "high"]


def table_shape(classes: int) -> tuple[int, int]:
    """Bits of a key and number of tables for so many distinct vectors."""
    bits = max(8, math.ceil(math.log2(max(2, classes))) + 1)
    agree = 1 - math.acos(COSINE) / math.pi
    return bits, math.ceil(math.log(1 - RECALL) / math.log1p(-(agree**bits)))


@lru_cache(maxsize=4)
def rotation(size: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task; the last ones used are kept."""
    normal = np.random.default_rng((size, number, 97)).normal(size=(size, size))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their signs as +-1, and the correction factors: the inner product
    of each rotated vector with its own scaled sign vector."""
    turned = unit @ rotation(unit.shape[1], 0).T
    signs = np.where(turned >= 0, 1.0, -1.0)
    return turned, signs, (turned * signs).sum(1) / math.sqrt(unit.shape[1])


def estimates(
    signs: np.ndarray, factor: np.ndarray, turned: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of coded vectors (rows) with rotated ones (columns),
    and for each row the half-width of the interval that holds the true cosine."""
    size = signs.shape[1]
    estimate = (signs @ turned.T) / math.sqrt(size) / factor[:, None]
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(1, size - 1))
    return estimate, ERRORS * spread


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    size = unit.shape[1]
    count = -(-bits * tables // size)
    turned = np.hstack([unit @ rotation(size, 1 + i).T for i in range(count)])
    signs = (turned[:, : bits * tables] >= 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _units(vectors: list[list[float]]) -> np.ndarray:
    raw = np.array(vectors, np.float64)
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _bucket_keys(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        keys: list = [None] * len(batch["node"])
        by_size: dict[int, list[int]] = {}
        for row, vector in enumerate(batch["vector"]):
            by_size.setdefault(len(vector), []).append(row)
        for rows in by_size.values():
            found = _keys(_units([batch["vector"][r] for r in rows]), bits, tables).tolist()
            for row, own in zip(rows, found, strict=True):
                keys[row] = own
        return {**batch, "keys": keys}

    schema = "node long, copies long, vector array<double>, keys array<bigint>"
    return map_rows(classes.select("node", "copies", "vector"), schema, rows_of)


def _compared(rows: list[dict]) -> Iterator[tuple[int, int, int]]:
    """(node, links it gains, least node of its local component) for one pair of blocks."""
    same = rows[0]["low"] == rows[0]["high"]
    left = rows if same else [r for r in rows if r["block"] == rows[0]["low"]]
    right = rows if same else [r for r in rows if r["block"] == rows[0]["high"]]
    if not left or not right or len(rows) < 2:
        return
    table = rows[0]["table"]
    a, b = (_units([r["vector"] for r in side]) for side in (left, right))
    _, signs, factor = codes(a)
    estimate, spread = estimates(signs, factor, b @ rotation(b.shape[1], 0).T)
    maybe = estimate + spread[:, None] >= COSINE
    if same:
        maybe &= np.tri(len(rows), k=-1, dtype=bool).T
    i, j = np.nonzero(maybe)
    keys_a, keys_b = (np.array([r["keys"][:table] for r in side]) for side in (left, right))
    linked = []
    for start in range(0, len(i), _CHUNK):
        own, other = i[start : start + _CHUNK], j[start : start + _CHUNK]
        good = (a[own] * b[other]).sum(1) >= COSINE
        own, other = own[good], other[good]
        if table:
            fresh = ~(keys_a[own] == keys_b[other]).any(1)
            own, other = own[fresh], other[fresh]
        linked.append((own, other))
    if not linked or not sum(len(own) for own, _ in linked):
        return
    i, j = (np.concatenate(x) for x in zip(*linked, strict=True))
    nodes = np.array([r["node"] for r in left] + ([] if same else [r["node"] for r in right]))
    copies = np.array([r["copies"] for r in left] + ([] if same else [r["copies"] for r in right]))
    j = j if same else j + len(left)
    gained = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    least = nodes.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        if (before == least).all():
            break
    for at in np.flatnonzero(gained):
        yield int(nodes[at]), int(gained[at]), int(least[at])


def _compare(blocks: DataFrame) -> DataFrame:
    """Every pair of blocks of a partition that is sorted by them."""
    fields = [("node", pa.int64()), ("gained", pa.int64()), ("least", pa.int64())]
    target = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[tuple[int, int, int]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and any(group[0][c] != row[c] for c in _GROUP):
                    out.extend(_compared(group))
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=target
                )
                out = []
        if group:
            out.extend(_compared(group))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=target
            )

    return blocks.mapInArrow(run, "node long, gained long, least long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Rows equal in id and vector count as one
    vector for links and each keep a row; null ids have a null component of their own and are
    kept; other columns are ignored.
    """
    rows = columns_as(vectors, vec_id=id_col, vector=vector_col).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("vector").cast("array<double>").alias("vector"),
    )
    bad = F.exists(
        "vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    good = ~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("good", good & F.col("vec_id").isNotNull())
    # A vector's hash names its class; 128 bits make two vectors of one hash a non-event.
    flat = F.array_join(F.transform("vector", lambda v: (v + 0.0).cast("string")), ",")
    rows = stage(rows.withColumn("class", F.when(F.col("good"), F.md5(flat))), "vectors")
    distinct = rows.where("good").select("class", "vec_id").distinct()
    counted = distinct.groupBy("class").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies")
    )
    counted = stage(counted, "classes")
    heads = rows.join(counted.withColumnRenamed("class", "class_of"),
                      (F.col("class") == F.col("class_of")) & (F.col("vec_id") == F.col("node")))
    heads = heads.dropDuplicates(["node", "class"])
    bits, tables = table_shape(counted.count())
    coded = stage(_bucket_keys(heads, bits, tables), "codes")
    size = F.size("vector").alias("size")
    placed = coded.select("node", size, F.posexplode("keys").alias("table", "key")).select(
        "node", "table", F.xxhash64("table", "key", "size").alias("bucket")
    )
    shared = placed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = placed.join(stage(shared, "buckets"), "bucket")
    count = F.ceil(F.col("members") / BLOCK)
    members = members.withColumn("blocks", count).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks"))
    )
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(
        "node", "table", "bucket", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )
    blocks = paired.join(coded, "node").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = stage(_compare(blocks), "links")
    gained = found.groupBy("node").agg(F.sum("gained").alias("gained"))
    roots = component_roots(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    roots = roots.withColumnRenamed("node", "root_of")

    totals = counted.join(gained, "node", "left").join(
        roots, F.col("node") == F.col("root_of"), "left"
    )
    linked = rows.join(totals.drop("root_of"), "class", "left")
    component = F.coalesce("root", "node", "vec_id")
    links = F.coalesce("gained", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return linked.select(
        "vec_id",
        links.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
