"""Connectors: what turns databases, API specifications and source trees into a graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skein.model import Graph


def open_source(spark: SparkSession, kind: str, source: str, **options) -> Graph:
    """Extract a graph by connector kind: sqlite, postgres, openapi, codebase or catalog."""
    from skein.sources import catalog, codebase, openapi, postgres, sqlite

    connectors = {"sqlite": sqlite.extract, "postgres": postgres.extract, "openapi": openapi.extract, "codebase": codebase.extract, "catalog": catalog.extract}
    if kind not in connectors:
        raise ValueError(f"unknown connector kind {kind!r}; known: {', '.join(sorted(connectors))}")
    return connectors[kind](spark, source, **options)
