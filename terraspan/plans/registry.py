"""All registered queries and their SQL."""

from __future__ import annotations

from terraspan.plans import (  # noqa: F401
    catalog_queries,
    geo_queries,
    ingest_queries,
    language_queries,
    raster_queries,
    review_queries,
    search_queries,
    temporal_queries,
)
from terraspan.plans._base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
