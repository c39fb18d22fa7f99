"""Reading and writing tables."""

from blotter.sources.batches import export_batches, with_batches
from blotter.sources.tables import read_incidents, read_table, write_results, write_table

__all__ = [
    "export_batches",
    "read_incidents",
    "read_table",
    "with_batches",
    "write_results",
    "write_table",
]
