"""Exact links between sets that share buckets, found in pairs of blocks of bounded size.

A set is known by a bitmap, in which each hash sets one bit. A bit of one bitmap that another
lacks stands for at least one hash that the other set lacks, so bitmaps bound the overlap of two
sets from above and never wrongly. Blocks of bitmaps are compared first. Of a pair of blocks only
the sets that the bounds leave undecided go on, as rows and not as pairs, and their overlaps are
counted on the full sets. What is put out is one row at most for each set of a pair of blocks:
the least set that it is linked with there, directly or through others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import discard
from fleetpulse.session import stage

#: Bytes of bitmaps in a block. A hash takes one to two bytes, so two blocks hold at most some
#: two million hashes, but for sets that are larger alone.
BLOCK_BYTES = 1 << 20
#: Bits of a bitmap for each hash, at least.
SPARSE = 8
#: Hashes whose holders are multiplied at once.
_COLUMNS = 4096
_GROUP = ("key", "low", "high")


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit per hash in a power of two of bits, named by the hash's last bits."""
    bits = 1 << max(6, int(SPARSE * len(hashes) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


class _Side:
    """Sets of one width as columns."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.roots = np.array([r["root"] for r in rows])
        self.sizes = np.array([r["size"] for r in rows])

    def words(self, width: int) -> np.ndarray:
        """The bitmaps folded to ``width`` bytes: as if they had been made with so few."""
        words = np.frombuffer(b"".join([r["bitmap"] for r in self.rows]), np.uint64)
        return np.bitwise_or.reduce(words.reshape(len(self.rows), -1, width // 8), axis=1)


def _near(size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(size, sizes) * 100 >= np.maximum(size, sizes) * percent


def _sides(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    low, high = rows[0]["low"], rows[0]["high"]
    if low == high:
        return rows, rows
    return [r for r in rows if r["block"] == low], [r for r in rows if r["block"] == high]


def undecided(rows: list[dict], percent: int) -> list[dict]:
    """The rows of a pair of blocks that the bitmaps do not rule out as linked with another root."""
    sides: list[dict[int, _Side]] = []
    for side in _sides(rows):
        widths: dict[int, list[dict]] = {}
        for row in side:
            widths.setdefault(len(row["bitmap"]), []).append(row)
        sides.append({width: _Side(held) for width, held in widths.items()})
    marked: set[int] = set()
    for width_a, a in sides[0].items():
        for width_b, b in sides[1].items():
            # Beyond a factor of two, one set is more than twice as large as the other.
            if max(width_a, width_b) > 2 * min(width_a, width_b):
                continue
            width = min(width_a, width_b)
            words_a, words_b = a.words(width), b.words(width)
            ones_a = np.bitwise_count(words_a).sum(1, dtype=np.int64)
            ones_b = np.bitwise_count(words_b).sum(1, dtype=np.int64)
            for i, row in enumerate(a.rows):
                size = row["size"]
                other = (b.roots != row["root"]) & _near(size, b.sizes, percent)
                j = np.flatnonzero(other)
                if not len(j):
                    continue
                common = np.bitwise_count(words_b[j] & words_a[i]).sum(1, dtype=np.int64)
                both = np.minimum(size - ones_a[i], b.sizes[j] - ones_b[j]) + common
                j = j[both * 100 >= (size + b.sizes[j] - both) * percent]
                if len(j):
                    marked.add(row["node"])
                    marked.update([b.rows[k]["node"] for k in j])
    return [row for row in rows if row["node"] in marked]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of every set of ``left`` with every set of ``right``.

    Where both are the same list, the diagonal is not meant.
    """
    flat_a, flat_b = np.concatenate(left), np.concatenate(right)
    if left is right:
        values, counts = np.unique(flat_a, return_counts=True)
        shared = values[counts > 1]
    else:
        shared = np.intersect1d(flat_a, flat_b)

    def held(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(shared, flat)
        known = np.flatnonzero(place < len(shared))
        known = known[shared[place[known]] == flat[known]]
        known = known[np.argsort(place[known], kind="stable")]
        return place[known], owner[known]

    total = np.zeros((len(left), len(right)), np.int64)
    (place_a, owner_a), (place_b, owner_b) = held(left, flat_a), held(right, flat_b)
    for start in range(0, len(shared), _COLUMNS):
        parts = []
        for place, owner, count in (
            (place_a, owner_a, len(left)),
            (place_b, owner_b, len(right)),
        ):
            first, last = np.searchsorted(place, [start, start + _COLUMNS])
            dense = np.zeros((count, _COLUMNS), np.float32)
            dense[owner[first:last], place[first:last] - start] = 1
            parts.append(dense)
        total += (parts[0] @ parts[1].T).astype(np.int64)
    return total


def linked(rows: list[dict], percent: int) -> list[dict]:
    """(a, b): a set and the least one that links of this pair of blocks tie it to."""
    left, right = _sides(rows)
    if not left or not right:
        return []
    own = [np.array(r["hashes"], np.int64) for r in left]
    others = own if left is right else [np.array(r["hashes"], np.int64) for r in right]
    both = overlaps(own, others)
    a, b = _Side(left), _Side(right)
    union = a.sizes[:, None] + b.sizes[None, :] - both
    i, j = np.nonzero(
        (a.roots[:, None] != b.roots[None, :]) & (both * 100 >= union * percent)
    )
    if not len(i):
        return []
    nodes = np.array([r["node"] for r in left] + [r["node"] for r in right])
    places = {node: place for place, node in enumerate(np.unique(nodes).tolist())}
    least = np.array(list(places))
    at = np.array([places[node] for node in nodes.tolist()])
    i, j = at[i], at[len(left) + j]
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        if (before == least).all():
            break
    ends = least.tolist()
    return [{"a": end, "b": node} for node, end in zip(places, ends, strict=True) if node != end]


def _by_groups(
    df: DataFrame, schema: str, target: pa.Schema, work: Callable[[list[dict]], list[dict]]
) -> DataFrame:
    """``work`` on the rows of each pair of blocks, one after another within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []

        def done(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=target)

        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if group and any(group[0][c] != row[c] for c in _GROUP):
                    out.extend(work(group) if len(group) > 1 else ())
                    group = []
                group.append(row)
            yield done(out)
        yield done(work(group) if len(group) > 1 else [])

    ordered = df.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return ordered.mapInArrow(run, schema)


def links_across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (key, node, root) of one bucket with different roots.

    ``sets`` has node, size, hashes, bitmap and its length as bytes; a node may have several. All pairs that share a bucket
    and have different roots are decided; the links put out tie the same sets together as all would.
    """
    sized = members.join(sets.select("node", "bytes"), "node")
    blocks = F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks")
    counted = sized.groupBy("key").agg(blocks)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = (
        members.join(counted, "key")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .select("key", "node", "root", "block", other)
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other")
    )
    placed = stage(placed, "block-rows")
    names = [*_GROUP, "block", "node", "root"]
    schema = ", ".join(f"{name} long" for name in names)
    target = pa.schema([(name, pa.int64()) for name in names])
    with_bits = placed.join(sets.select("node", "size", "bitmap"), "node")
    left = _by_groups(
        with_bits,
        schema,
        target,
        lambda rows: [{name: row[name] for name in names} for row in undecided(rows, percent)],
    )
    left = stage(left, "undecided-rows")
    discard(placed)
    found = _by_groups(
        left.distinct().join(sets.select("node", "size", "hashes"), "node"),
        "a long, b long",
        pa.schema([("a", pa.int64()), ("b", pa.int64())]),
        lambda rows: linked(rows, percent),
    )
    found = stage(found.distinct(), "links-across")
    discard(left)
    return found
