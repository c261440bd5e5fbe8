"""Every query of the library by name, and for those that SQL can express, the SQL for DuckDB."""

from .plans.oracle import ORACLE_SQL
from .plans.queries import QUERIES

FLAGSHIP = "keyword_counts"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
