"""DuckDB SQL for the queries of the same names."""

from __future__ import annotations

from polyloom.registry import catalog, extensions, layout, media, more, text

ORACLES: dict[str, str] = {}
for _part in (text, catalog, media, layout, extensions, more):
    ORACLES |= _part.ORACLES
