from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A name for use in an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text as a string in an expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def column(name: str) -> Column:
    """The column called ``name``."""
    return F.col(quoted(name))


def index_name(name: str) -> str:
    """Name of the indexed form of a column: ``Primary Type`` -> ``i_primary_type``."""
    return "i_" + "_".join(name.lower().split(" "))
