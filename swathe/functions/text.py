"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as white space in Unicode text. Spark's plain
# ``trim`` strips U+0020 only.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))


def strip(column: Column | str) -> Column:
    """Both ends stripped of any Unicode white space."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(c, F.lit(WHITESPACE))


def normalise_key(column: Column | str) -> Column:
    """Canonical form of a de-duplication key: text, stripped, lower case, empty as null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(strip(c.cast("string"))), F.lit(""))


def type_name(column: Column | str) -> Column:
    """Entity and action names as they are looked up: stripped and lower case."""
    return F.lower(strip(column))


def truncate(column: Column | str, length: int) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.substring(c, 1, length)


def stable_id(*parts: Column | str) -> Column:
    """Reproducible identifier of a row from its natural key (unlike ``uuid()``, the same on
    every recomputation)."""
    return F.sha2(F.concat_ws("\x1f", *[
        F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x00"))
        for p in parts]), 256)
