"""Tidemark: tick analytics expressed as Spark DataFrame plans."""

from tidemark.engine import Engine, open_engine

__all__ = ["Engine", "open_engine"]
