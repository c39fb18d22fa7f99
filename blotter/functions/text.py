from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.schema import TOKEN_SEPARATORS


def tokenize(text: Column) -> Column:
    """Lower-case words of a text, in order; null stays null, no words give an empty array."""
    blanked = F.translate(F.lower(text), TOKEN_SEPARATORS, " " * len(TOKEN_SEPARATORS))
    return F.filter(F.split(blanked, " "), lambda word: word != "")
