"""Occurrence times are text such as ``04/16/2020 5:00:00 AM``.

The text has no zone and is read without one, so the session's zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blotter.schema import DATE_PATTERN, MONTH_LABELS


def occurred_at(text: Column) -> Column:
    """The text as a timestamp without zone; null where it cannot be read."""
    readable = F.try_to_timestamp(text, F.lit(DATE_PATTERN)).isNotNull()
    return F.when(readable, F.to_timestamp_ntz(text, F.lit(DATE_PATTERN)))


def hour_of(text: Column) -> Column:
    """Hour of day 0-23; 12 AM is 0."""
    return F.hour(occurred_at(text))


def month_of(text: Column) -> Column:
    """What stands before the first slash of the first word: ``01`` .. ``12``."""
    return F.regexp_extract(text, r"^\s*([^\s/]*)", 1)


def month_label(month: Column) -> Column:
    """``01`` -> ``Jan``; null for anything that is no month."""
    labels = F.array(*[F.lit(m) for m in MONTH_LABELS])
    number = month.try_cast("int")
    return F.when(number.between(1, 12), F.get(labels, number - 1))
