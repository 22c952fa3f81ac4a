"""All queries of the catalog, tile and workspace operators by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import queries as scalar
from tessera.operators import catalog, layouts, matrices, raster, spatial
from tessera.streaming import requests

FAMILIES = [catalog.FAMILY, scalar.FAMILY, spatial.FAMILY, layouts.FAMILY, matrices.FAMILY, raster.FAMILY, requests.FAMILY]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _family in FAMILIES:
    QUERIES |= _family.queries
    SQL |= _family.sql
