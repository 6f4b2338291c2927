"""Meeting-transcript analytics as Spark jobs."""

from .session import build_session, configure, work_dir

__all__ = ["build_session", "configure", "work_dir"]
