"""Registered queries of the reference operators and their DuckDB SQL."""

from __future__ import annotations

from . import evaluation, maintenance, relational, scalars, streams
from .registry import ORACLE_SQL, QUERIES

MODULES = (scalars, relational, evaluation, maintenance, streams)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
