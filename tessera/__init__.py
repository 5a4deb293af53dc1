"""tessera: analytics on DataFrames, Spark SQL and Structured Streaming."""

from tessera.session import session
from tessera.tables import TABLES, table

__all__ = ["TABLES", "session", "table"]
