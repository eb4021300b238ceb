"""Registered queries of the media-library operators and their SQL twins."""

from . import aggregates, filters, incremental, joins, mutations, ranking, scalars, sources, surface, vectors  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
