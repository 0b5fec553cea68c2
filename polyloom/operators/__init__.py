"""Relational and sequential operators over documents, layouts, catalogs, rasters and audio."""
