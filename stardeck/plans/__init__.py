"""Queries by name, with their SQL."""

from . import device_queries, display_queries, frame_queries, media_queries, sky_queries, stack_queries, star_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "device_queries", "display_queries", "frame_queries", "media_queries", "sky_queries", "stack_queries", "star_queries", "text_queries"]
