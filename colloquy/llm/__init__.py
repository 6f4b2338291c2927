"""Operators of a training-data pipeline, each with a query over the given tables."""

from . import queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
