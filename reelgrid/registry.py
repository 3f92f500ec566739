"""Query name -> function, and query name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelgrid.plans import decisions, grouping, joins, records, timelines, validation

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (grouping, timelines, joins, records, decisions, validation)
QUERIES: dict[str, Query] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
