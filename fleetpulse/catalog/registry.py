"""Registry of checked queries.

A query pairs a Spark callable with the SQL that must give the same rows. Both sides
present their columns through one spec, so names, rounding and types agree:
``name`` as is, ``name:4`` rounded, ``name:i`` as a big integer, ``name:us`` a timestamp
as microseconds (column ``name_us``), ``name:e6`` seconds as whole microseconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def _parts(spec: str) -> list[tuple[str, str]]:
    return [tuple((token + ":").split(":")[:2]) for token in spec.split()]


def present(df: DataFrame, spec: str) -> DataFrame:
    """Select the spec's columns from a Spark frame."""

    def column(name: str, kind: str):
        value = F.col(f"`{name}`")
        if kind == "us":
            return F.unix_micros(value).alias(f"{name}_us")
        if kind == "e6":
            return F.round(value * 1e6).cast("bigint").alias(name)
        if kind == "i":
            return value.cast("bigint").alias(name)
        if kind:
            # Adding zero turns a negative zero into a plain one.
            return (F.round(value.cast("double"), int(kind)) + F.lit(0.0)).alias(name)
        return value

    return df.select(*[column(name, kind) for name, kind in _parts(spec)])


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind == "us":
        return f'epoch_us({quoted}) AS "{name}_us"'
    if kind == "e6":
        return f"CAST(round({quoted} * 1e6) AS BIGINT) AS {quoted}"
    if kind == "i":
        return f"CAST({quoted} AS BIGINT) AS {quoted}"
    if kind:
        return f"round(CAST({quoted} AS DOUBLE), {kind}) + 0e0 AS {quoted}"
    return quoted


def _used(text: str, seen: set[str]) -> set[str]:
    for name in set(re.findall(r"[a-z_]\w*", text)) & CTES.keys() - seen:
        seen.add(name)
        _used(CTES[name], seen)
    return seen


def with_ctes(select: str, recursive: bool = False) -> str:
    """Prefix a SELECT with the shared table expressions it uses, in definition order."""
    used = _used(select, set())
    chain = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items() if name in used)
    return f"WITH {'RECURSIVE ' if recursive else ''}{chain}\n{select}" if chain else select


def query(name: str, spec: str, sql: str | None = None, recursive: bool = False):
    """Register a Spark query; ``sql`` is a table name or SELECT to present alike."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(build(configure(spark), sf_dir), spec)

        QUERIES[name] = run
        if sql is not None:
            source = sql if re.fullmatch(r"\w+", sql) else f"({sql})"
            columns = ", ".join(_sql_column(*part) for part in _parts(spec))
            ORACLES[name] = with_ctes(f"SELECT {columns} FROM {source} AS shown", recursive)
        return build

    return register
