"""Every operator as a query over the supplied tables, with the SQL it must agree with."""

from blotter.queries import features, models, reports, tables, texts  # noqa: F401  (they register)
from blotter.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
