"""sparkrecon: numeric work and numeric checking on large tables, as Spark jobs."""

from sparkrecon.session import build_session

__all__ = ["build_session"]
