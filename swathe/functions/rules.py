"""Declared field rules as Column expressions, for validating whole tables of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathe.functions.text import strip
from swathe.model import NUMERIC_TYPES, FieldRule


def coerced(raw: Column, rule: FieldRule) -> Column:
    """Text as the declared type: stripped text, or a number (null when it is none)."""
    if rule.type == "string":
        return strip(raw)
    text = strip(raw)
    if rule.type in ("int", "bigint"):
        # A whole number only: "42" and "42.0" are, "42.5" is not.
        number = text.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number.try_cast(rule.type))
    return text.try_cast(rule.type)


def field_error(raw: Column, rule: FieldRule) -> Column:
    """Name of the first violated rule of a text value, or null. Same rules and names as
    :meth:`swathe.model.FieldRule.coerce`."""
    value = coerced(raw, rule)
    error = F.when(raw.isNull(), F.lit(None if rule.nullable else "null_not_allowed"))
    if rule.type == "string":
        if rule.min_length is not None:
            error = error.when(F.char_length(value) < rule.min_length, "too_short")
        if rule.max_length is not None:
            error = error.when(F.char_length(value) > rule.max_length, "too_long")
        if rule.pattern is not None:
            # (?U): white space in patterns is Unicode white space, as everywhere else here.
            error = error.when(~value.rlike(f"(?U){rule.pattern}"), "pattern_mismatch")
    elif rule.type == "timestamp":
        error = error.when(value.isNull(), "not_a_timestamp")
    elif rule.type in NUMERIC_TYPES:
        error = error.when(value.isNull(), "not_a_number")
        if rule.minimum is not None:
            error = error.when(value < F.lit(rule.minimum), "below_minimum")
        if rule.maximum is not None:
            error = error.when(value > F.lit(rule.maximum), "above_maximum")
    return error


def issue(field: str, error: Column) -> Column:
    """One entry of an error list: null when there is no error."""
    return F.when(error.isNotNull(), F.struct(F.lit(field).alias("field"), error.alias("error")))


def issues(*entries: Column) -> Column:
    """Error list of a row: the entries that are not null."""
    return F.array_compact(F.array(*entries))


def when_true(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))
