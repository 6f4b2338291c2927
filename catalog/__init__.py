"""Every operator on the given tables, each beside the SQL that says what must come out."""

from . import (  # noqa: F401
    columns,
    files,
    items,
    jobs,
    joins,
    logs,
    media,
    mining,
    replies,
    streams,
    summaries,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
