"""The registry of the library's own queries: each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyloom.registry import catalog, extensions, layout, media, more, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
for _part in (text, catalog, media, layout, extensions, more):
    QUERIES |= _part.QUERIES
