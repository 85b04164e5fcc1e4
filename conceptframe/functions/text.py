"""Text expressions that stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns; both are spelled so that Java and RE2 read them alike.
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
WHITESPACE = r"[\p{Z}\t\n\x0B\f\r\x1c-\x1f\x{85}]+"


def tokens(text: Column) -> Column:
    """Lower-cased letter/number runs of a text."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def collapse(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def normalized_group(text: Column) -> Column:
    """Key of near-trivial duplicates: digest of the lower-cased, whitespace-collapsed text."""
    return F.sha2(collapse(F.lower(text)), 256)
