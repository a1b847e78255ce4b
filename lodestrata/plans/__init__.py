"""Named queries, each with the SQL that defines its rows."""

from . import index, lines, misc, search, semantic, structure, usage  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
