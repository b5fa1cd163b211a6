"""Reckoner: recommendation analytics as Spark DataFrame operators."""

from reckoner.session import build_session

__all__ = ["build_session"]
