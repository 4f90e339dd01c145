"""All queries of the raster engine and their SQL."""

from tessera.plans import pixel_queries, raster_queries, scene_queries, seam_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
