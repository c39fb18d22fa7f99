"""DuckDB SQL that several oracles share."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


SPACED = r"[^\x20\x09-\x0D]+"
ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
