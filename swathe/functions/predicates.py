"""JSON filter objects as Column predicates.

``{field: value}`` or ``{field: {op: value, ...}}``; all entries and operators are and-ed. Values
are checked and cast to the column's type when the filter is compiled, so Catalyst can push the
comparisons to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathe.model import EntitySpec, RequestError

_COMPARISONS = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
OPERATORS = ("eq", "ne", *_COMPARISONS, "in", "not_in", "contains", "is_null")


def check_filter(entity: EntitySpec, filters: Mapping[str, Any] | None, columns: list[str]) -> None:
    """Refuse fields that may not be filtered and operators that do not exist."""
    allowed = entity.filterable(columns)
    for name, condition in (filters or {}).items():
        if name not in allowed:
            raise RequestError(f"{name!r} is not filterable on {entity.name!r}; "
                               f"filterable: {sorted(allowed)}")
        if isinstance(condition, Mapping):
            unknown = sorted(set(condition) - set(OPERATORS))
            if unknown:
                raise RequestError(f"unknown operators {unknown} on {name!r}; "
                                   f"known: {sorted(OPERATORS)}")


def compile_filter(entity: EntitySpec, filters: Mapping[str, Any] | None, df: DataFrame) -> Column:
    """The filter as one predicate on ``df``; an empty filter accepts every row."""
    check_filter(entity, filters, df.columns)
    predicates = []
    for name, condition in (filters or {}).items():
        ops = condition if isinstance(condition, Mapping) else {"eq": condition}
        dtype = df.schema[name].dataType
        predicates += [_predicate(name, dtype, op, value) for op, value in ops.items()]
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def _predicate(name: str, dtype: T.DataType, op: str, value: Any) -> Column:
    column = F.col(name)
    if op == "is_null":
        return column.isNull() if value else column.isNotNull()
    if op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)) or not value:
            raise RequestError(f"operator {op!r} on {name!r} needs a non-empty list")
        member = column.isin([_literal(name, dtype, v) for v in value])
        return member if op == "in" else ~member
    if op == "contains":
        if not isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
            raise RequestError(f"operator 'contains' needs a text field, {name!r} is "
                               f"{dtype.simpleString()}")
        return F.contains(F.lower(column), F.lit(str(value).lower()))
    if value is None:
        # Equality with null asks for missing values; an order comparison with it holds nowhere.
        return {"eq": column.isNull(), "ne": column.isNotNull()}.get(op, F.lit(False))
    literal = _literal(name, dtype, value)
    if op == "eq":
        return column == literal
    if op == "ne":
        return column != literal
    return _COMPARISONS[op](column, literal)


def _literal(name: str, dtype: T.DataType, value: Any) -> Column:
    try:
        if value is None:
            pass
        elif isinstance(dtype, T.IntegralType):
            if isinstance(value, bool):
                raise ValueError(value)
            if isinstance(value, float) and not value.is_integer():
                if value != value or value in (float("inf"), float("-inf")):
                    raise ValueError(value)
                return F.lit(value)  # age < 29.5 must keep 29: no cast to the column type
            value = int(value)
            if value.bit_length() > _BITS[type(dtype)] - 1 and value != -(
                    1 << _BITS[type(dtype)] - 1):
                raise ValueError(value)
        elif isinstance(dtype, T.DecimalType):
            # Compared as a decimal of its own scale: a cast to the column's would round it.
            number = Decimal(str(value))
            if isinstance(value, bool) or not number.is_finite():
                raise ValueError(value)
            return F.lit(number)
        elif isinstance(dtype, T.FractionalType):
            value = float(value)
        elif isinstance(dtype, T.BooleanType):
            if not isinstance(value, bool):
                raise ValueError(value)
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            moment = datetime.fromisoformat(str(value))
            if moment.tzinfo is not None:  # zone-less columns hold UTC
                moment = moment.astimezone(UTC).replace(tzinfo=None)
            value = f"{moment}Z" if isinstance(dtype, T.TimestampType) else str(moment)
        elif not isinstance(value, str):
            raise ValueError(value)
    except (ArithmeticError, TypeError, ValueError):
        raise RequestError(f"value {value!r} does not fit {name!r} "
                           f"({dtype.simpleString()})") from None
    return F.lit(value).cast(dtype)
