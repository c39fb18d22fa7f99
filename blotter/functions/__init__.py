"""Column functions: dates, text, numbers and names."""

from blotter.functions.dates import hour_of, month_label, month_of, occurred_at
from blotter.functions.names import column, index_name
from blotter.functions.numbers import as_percentage, total, zero_if_null
from blotter.functions.text import tokenize

__all__ = [
    "as_percentage",
    "column",
    "hour_of",
    "index_name",
    "month_label",
    "month_of",
    "occurred_at",
    "tokenize",
    "total",
    "zero_if_null",
]
