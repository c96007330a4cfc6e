"""Reading the tables."""

from tidemark.sources.tables import table

__all__ = ["table"]
