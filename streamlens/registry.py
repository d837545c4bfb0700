"""Registry of the engine's own queries: each plan module contributes QUERIES and ORACLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "burst_arcs"
MODULES: list[str] = ["signals", "retrieval", "spans", "clips", "memory", "details", "building", "decks", "moments", "moment_decks", "indexing", "speaking", "boundary_chain"]


def _modules():
    import importlib

    return [importlib.import_module(f"streamlens.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
