"""Every registered query of the table operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import graph_queries, package_queries, patch_queries, relational_queries, scalar_queries, typed_queries  # noqa: F401
from .base import QUERIES, SQL

FLAGSHIP = "left_join_files"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
