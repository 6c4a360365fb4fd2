"""Queries over the test tables, each with an independent SQL twin where one exists."""

from importlib import import_module

_MODULES = (
    "telemetry_queries",
    "metrics_queries",
    "score_queries",
    "stream_queries",
    "model_queries",
)


def load_catalog() -> None:
    for name in _MODULES:
        import_module(f"fleetpulse.catalog.{name}")
