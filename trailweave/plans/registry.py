"""All queries of the engine proper, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailweave.plans import agents, basics, files, ingest, navigation, observations, state, stores, text

FLAGSHIP = "trj_r2r_summary"
Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    return [navigation, text, agents, ingest, state, basics, observations, stores, files]


def queries() -> dict[str, Query]:
    """Query name -> callable."""
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL; names without an entry are not expressible in SQL."""
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
