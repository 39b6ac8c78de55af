"""lodestone: SQL analytics over typed tables, planned and run by Spark."""

from lodestone.session import Engine

__all__ = ["Engine"]
