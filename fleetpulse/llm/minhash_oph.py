"""MinHash near-duplicates: one-permutation hashing with optimal densification.

A document is its set of distinct word shingles. One hash per shingle fills ``BINS`` bins with
their least values; an empty bin borrows from a full one that a fixed random order of bins
names, the same order for every document. Bands of ``ROWS`` bins give buckets.

Documents with equal sets form one class and only its smallest id goes on. Candidates come as
stars: every bucket ties its members to one of them, so pairs grow with the members. Links are
confirmed on full sets. Buckets whose members then still lie in several components are tied
again around other centres, and what stays apart is decided exactly in pairs of blocks
(``set_blocks``), across components only, so no link that shares a bucket is lost, no pairs of a
bucket are put out and members of one component are never compared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as, discard, map_rows
from fleetpulse.llm.components import component_roots
from fleetpulse.llm.set_blocks import bitmap, links_across
from fleetpulse.session import stage

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4: a pair at 0.75 shares no bucket with probability 0.000005.
BINS, ROWS = 128, 4
#: Bits of the hash that number its bin, and attempts of an empty bin before the nearest one.
_BIN_BITS, _ATTEMPTS = BINS.bit_length() - 1, 1024

#: Bits kept of each bin's value, and in how many bins a star's pair may differ to be confirmed at
#: once: at a similarity of 0.75, 30 differ on average. Other pairs are decided afterwards.
PLANES, MOST_DIFFERENT = 4, 56

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_ORDER = np.random.default_rng(20_240_601).integers(0, BINS, (_ATTEMPTS, BINS))
_WEIGHTS = np.random.default_rng(7).integers(1, 2**63, max(SHINGLE, ROWS), dtype=np.uint64) | 1
_BANDS = np.arange(BINS // ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93 % 2**64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, as long as the longest text."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, size: int) -> None:
        if size > len(self.up):
            size = max(size, 2 * len(self.up))
            steps = np.full(size, _BASE, np.uint64)
            back = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)


_POWERS = _Powers()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A-Z lower-cased."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    _POWERS.grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], out=sums[1:])
    words = _mixed((sums[stops] - sums[starts]) * _POWERS.down[starts])
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    total = np.full(count, size, np.uint64)
    for i in range(size):
        total += words[i : i + count] * _WEIGHTS[i]
    return np.unique(_mixed(total))


def sketched(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket keys of a non-empty set of sorted hashes, and ``PLANES`` bits of every bin's
    value as 64-bit words: plane by plane, one bit per bin."""
    bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)
    values = np.zeros(BINS, np.uint64)
    values[full] = hashes[first]
    filled = np.zeros(BINS, bool)
    filled[full] = True
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    for start in range(0, _ATTEMPTS, 32):
        if not len(empty):
            break
        tried = _ORDER[start : start + 32, empty]
        good = filled[tried]
        hit = good.any(0)
        source[empty[hit]] = tried[good.argmax(0)[hit], np.flatnonzero(hit)]
        empty = empty[~hit]
    if len(empty):
        source[empty] = full[np.searchsorted(full, empty) % len(full)]
    mixed = _mixed(values[source])
    rows = mixed.reshape(-1, ROWS)
    keys = _mixed((rows * _WEIGHTS[:ROWS]).sum(1, dtype=np.uint64) + _BANDS)
    bits = (mixed >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return keys, np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _fingerprint(hashes: np.ndarray) -> list[int]:
    """128 bits that tell sets apart."""
    sums = [_mixed(hashes + np.uint64(salt)).sum(dtype=np.uint64) for salt in (1, 2)]
    return _signed(np.array(sums))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (one, two), bucket keys and bits."""

    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        made: dict[str, list] = {"n_shingles": [], "one": [], "two": []}
        made |= {"keys": [], "bits": []}
        for text in batch["text"]:
            hashes = shingle_hashes(text)
            one, two = _fingerprint(hashes)
            made["n_shingles"].append(len(hashes))
            made["one"].append(one)
            made["two"].append(two)
            for name, values in zip(("keys", "bits"), sketched(hashes) if len(hashes) else (), strict=False):
                made[name].append(_signed(values))
            if not len(hashes):
                made["keys"].append([])
                made["bits"].append([])
        return {"doc_id": batch["doc_id"], **made}

    schema = "doc_id long, n_shingles long, one long, two long, keys array<bigint>, bits array<bigint>"
    return map_rows(docs, schema, rows_of)


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full sets of the named documents and their bitmaps; one row if an id repeats a set."""

    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        hashes = [shingle_hashes(text) for text in batch["text"]]
        bitmaps = [bitmap(h) for h in hashes]
        prints = [_fingerprint(h) for h in hashes]
        return {
            "node": batch["doc_id"],
            "size": [len(h) for h in hashes],
            "hashes": [_signed(h) for h in hashes],
            "bitmap": bitmaps,
            "bytes": [len(b) for b in bitmaps],
            "one": [one for one, _ in prints],
            "two": [two for _, two in prints],
        }

    wanted = docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi")
    schema = "node long, size long, hashes array<bigint>, bitmap binary, bytes long, one long, two long"
    return map_rows(wanted, schema, rows_of).dropDuplicates(["node", "one", "two"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of_a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    of_b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    joined = pairs.join(of_b, "b").join(of_a, "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return joined.where(both * 100 >= union * PERCENT).select("a", "b")


def _hopeful(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bin values speak for a link.

    Only stars ask this. What it leaves out loses nothing: documents that stars do not tie are
    compared afterwards, without this bound.
    """

    def side(name: str) -> DataFrame:
        return heads.select(
            F.col("node").alias(name),
            F.col("size").alias(f"size_{name}"),
            F.col("bits").alias(f"bits_{name}"),
        )

    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    sizes = F.col("size_a"), F.col("size_b")
    near = F.least(*sizes) * 100 >= F.greatest(*sizes) * PERCENT
    words, different = BINS // 64, F.lit(0)
    for word in range(words):
        differs = F.lit(0).cast("long")
        for plane in range(PLANES):
            place = plane * words + word
            differs = differs.bitwiseOR(F.col("bits_a")[place].bitwiseXOR(F.col("bits_b")[place]))
        different = different + F.bit_count(differs)
    return joined.where(near & (different <= MOST_DIFFERENT)).select("a", "b")


def _stars(members: DataFrame, order: Column) -> DataFrame:
    """Each bucket's members tied to the one that comes first in ``order``."""
    first = F.min(F.struct(order.alias("order"), "node", "root")).alias("first")
    centres = members.groupBy("key").agg(first).select(
        "key", F.col("first.node").alias("a"), F.col("first.root").alias("root_a")
    )
    tied = members.join(centres, "key").where(F.col("root") != F.col("root_a"))
    return tied.select("a", F.col("node").alias("b")).distinct()


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with their components, of the buckets that hold more than one component."""
    rooted = members.drop("root").join(component_roots(links), "node", "left")
    rooted = stage(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")
    several = (
        rooted.groupBy("key")
        .agg(F.min("root").alias("least"), F.max("root").alias("most"))
        .where("least < most")
        .select("key")
    )
    apart = stage(rooted.join(several, "key", "left_semi"), "apart")
    discard(rooted)
    return apart


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept.

    Null texts and texts without words link with nothing. Rows that share an id count as one
    document for links; a null id joins its text's group but names none (a group of null ids
    only has a null component). Other columns are ignored.
    """
    docs = columns_as(docs, doc_id=id_col, text=text_col)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    whole = stage(sketch(docs), "sketches")
    same = ["n_shingles", "one", "two"]
    classes = whole.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node"))
    classes = stage(classes.where(F.col("node").isNotNull()), "classes")
    named = classes.select(*[F.col(c).alias(f"{c}_of") for c in same], F.col("node"))
    equal = [F.col(c) == F.col(f"{c}_of") for c in same]
    heads = whole.join(named, [F.col("doc_id") == F.col("node"), *equal])
    heads = stage(heads.select("node", F.col("n_shingles").alias("size"), "keys", "bits"), "heads")
    base = stage(whole.select("doc_id", *same), "prints")
    discard(whole)
    members = heads.select(F.explode("keys").alias("key"), "node")
    shared = (
        members.groupBy("key")
        .agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .where("least < most")
        .select("key")
    )
    shared = stage(shared, "shared-buckets")
    members = stage(members.join(shared, "key", "left_semi").distinct(), "members")
    discard(shared)
    nodes = stage(members.select("node").distinct(), "nodes")
    sets = stage(_full_sets(docs, nodes), "full-sets")
    discard(nodes)

    def confirmed(stars: DataFrame) -> DataFrame:
        pairs = stage(_hopeful(stars, heads), "pairs")
        links = stage(_confirmed(pairs, sets), "links")
        discard(pairs)
        return links

    rooted = members.withColumn("root", F.col("node"))
    links = confirmed(_stars(rooted, F.col("node")))
    apart = _apart(rooted, links)
    discard(members)
    links = links.union(confirmed(_stars(apart, F.xxhash64("key", "node"))))
    discard(heads)
    left = _apart(apart, links)
    discard(apart)
    links = links.union(links_across(left, sets, PERCENT))
    discard(left, sets)
    roots = component_roots(links)

    grouped = base.join(classes, same, "left").join(roots, "node", "left")
    component = F.coalesce("root", "node", "doc_id").alias("component_id")
    return grouped.select(
        "doc_id",
        "n_shingles",
        component,
        F.col("doc_id").eqNullSafe(F.coalesce("root", "node", "doc_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Rows that repeat an id and text are one document, of which one row stays; of rows that
    share an id but not the text, the first text in order stays. Rows of null ids stay: they
    cannot be told apart.
    """
    found = near_duplicates(docs, id_col, text_col).where("kept AND doc_id IS NOT NULL")
    ids = stage(found.groupBy("doc_id").agg(F.count("*").alias("n")), "kept-ids")
    key, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    single, repeated = ids.where("n = 1"), ids.where("n > 1")
    once = docs.join(single, key.cast("long") == single["doc_id"], "left_semi")
    again = docs.join(repeated, key.cast("long") == repeated["doc_id"], "left_semi").select(
        key.alias("key"), text.alias("order"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    )
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("order")))
    first = again.withColumn("place", place).where("place = 1").select("doc.*")
    return once.union(first).union(docs.where(key.isNull()))
