"""What ``__spark_entry__`` takes from this package."""

from markloom.llm.queries import QUERIES
from markloom.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
