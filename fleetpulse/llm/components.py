"""Connected components of link tables, by hooking and pointer jumping on shrinking graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import stage


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    return edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct()


def _followed(left: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """``left`` with ``key`` replaced by its root, where it has one; ``moved`` tells if so."""
    named = roots.select(F.col("hi").alias("root_of"), F.col("lo").alias("root"))
    joined = left.join(named, F.col(key) == F.col("root_of"), "left")
    moved = F.col("root").isNotNull()
    return joined.withColumn(key, F.coalesce("root", key)).withColumn("moved", moved).drop(
        "root_of", "root"
    )


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b) but the smallest of each
    component, which is the root of the others.

    Each round hooks every node to its smallest smaller neighbour, follows these hooks to
    their ends, and goes on with the edges between different ends. Every table is written, so
    each join has plain shuffles on both sides (a hot root is split at run time) and no round
    repeats the ones before.
    """
    left = stage(_ordered(edges, "a", "b"), "edges")
    roots: DataFrame | None = None
    while not left.isEmpty():
        hooks = stage(left.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks")
        while True:
            jumped = stage(_followed(hooks, "lo", hooks), "jumps")
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if roots is None:
            roots = hooks
        else:
            roots = stage(_followed(roots, "lo", hooks).drop("moved").union(hooks), "roots")
        ends = _followed(_followed(left, "hi", hooks).drop("moved"), "lo", hooks)
        left = stage(_ordered(ends, "hi", "lo"), "edges")
    if roots is None:
        roots = left
    return roots.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
