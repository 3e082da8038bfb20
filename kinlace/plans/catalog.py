"""Named queries over the tables of a directory, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from kinlace.plans import library_queries, play_queries, resolution_queries, stream_queries
from kinlace.plans.registry import QUERIES, SQL

FLAGSHIP = "set_overlap"

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "library_queries", "play_queries", "resolution_queries", "stream_queries"]
