"""Queries over the given tables, one for each operator."""

from tarnspark.plans import feature_queries, line_queries, network_queries, place_queries, raster_queries, source_queries  # noqa: F401
from tarnspark.plans.registry import ORACLES, QUERIES, SLOW_SQL, also

for _name in ("grade_match", "line_snap", "place_search", "search_merge", "remaining_bytes", "parking_order", "fold_text"):
    if f"{_name}_all" not in QUERIES:
        also(f"{_name}_all", _name)  # from when the first name asked fewer rows

__all__ = ["ORACLES", "QUERIES", "SLOW_SQL"]
