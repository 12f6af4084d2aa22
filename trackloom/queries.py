"""Queries over the driver tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import evaluation, extras, folds, frames, graph, projection, records, roads, scoring, series, sinks, spatial, streaming

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (series, scoring, spatial, roads, projection, evaluation, folds, graph, streaming, sinks, extras, frames, records)


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
