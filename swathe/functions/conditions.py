"""JSON filters held in a column, as typed conditions that a row can be tested against.

:mod:`swathe.functions.predicates` compiles one filter while a job is planned. Here the filters are
data: a table of requests carries one each, parsed once as VARIANT. Every filterable field becomes
a struct with one typed slot per operator, so that a filter is tested by comparing slots and no text
is parsed per row.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swathe.functions.predicates import OPERATORS
from swathe.model import EntitySpec

_COMPARED = ("eq", "ne", "gt", "gte", "lt", "lte")
_EXACT = "decimal(38,18)"  # holds every bigint and 18 digits of a fraction
_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def member(value: Column | str, name: str) -> Column:
    """Member ``name`` of an object as VARIANT, null if there is none."""
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def kind_of(value: Column | str) -> Column:
    """JSON kind: object, array, string, boolean, void (JSON's null) or a type of number; null
    where there is no value."""
    return F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def members(value: Column | str) -> Column:
    """Names of an object's members; null for other kinds."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def comparand_type(column: T.DataType) -> str:
    """Type in which values of a filter are compared with a column of this type."""
    return _EXACT if isinstance(column, T.IntegralType) else column.simpleString()


def typed(value: Column, column: T.DataType) -> Column:
    """A scalar in the comparand type of ``column``; null if it does not fit."""
    if isinstance(column, (T.StringType, T.BooleanType)):
        kind = column.simpleString()
        return F.when(kind_of(value) == kind, F.try_variant_get(value, "$", kind))
    if isinstance(column, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string")
                      ).try_cast("timestamp").cast(column)
    number = F.when(~kind_of(value).isin("object", "array", "boolean", "void"),
                    F.try_variant_get(value, "$", comparand_type(column)))
    if not isinstance(column, T.IntegralType):
        return number
    most = (1 << _BITS[type(column)]) - 1
    return F.get(F.filter(F.array(number), lambda x: x.between(
        F.lit(-most - 1).cast(_EXACT), F.lit(most).cast(_EXACT))), F.lit(0))


def _items(value: Column, column: T.DataType) -> Column:
    """Elements of an array as (v, void): typed, and whether they are JSON's null."""
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.struct(
        typed(v, column).alias("v"), (kind_of(v) == "void").alias("void")))


def with_conditions(requests: DataFrame, entity: EntitySpec, schema: T.StructType, filters: str
                    ) -> DataFrame:
    """Add ``conds``, the filter in the VARIANT column ``filters`` as one struct of slots per
    filterable field, and ``misfits``: names that may not be filtered, and those with an unknown
    operator or a value that does not fit the field. Step by step, so each value is read once."""
    names = entity.filterable(schema.names)
    given = requests.columns
    rows = requests.withColumns({f"_v_{n}": member(filters, n) for n in names})
    rows = rows.withColumns({f"_o_{n}": kind_of(f"_v_{n}") == "object" for n in names})
    raw = {}
    for n in names:
        value, nested = F.col(f"_v_{n}"), F.col(f"_o_{n}")
        for op in OPERATORS:
            inner = F.when(nested, member(value, op))
            raw[f"_r_{n}_{op}"] = F.when(~nested, value).otherwise(inner) if op == "eq" else inner
    rows = rows.withColumns(raw)
    slots = {}
    for n in names:
        kind, r = schema[n].dataType, {op: F.col(f"_r_{n}_{op}") for op in OPERATORS}
        for op in _COMPARED:
            slots[f"_s_{n}_{op}"] = typed(r[op], kind)
            slots[f"_n_{n}_{op}"] = F.coalesce(kind_of(r[op]) == "void", F.lit(False))
        for op in ("in", "not_in"):
            slots[f"_s_{n}_{op}"] = _items(r[op], kind)
        slots[f"_s_{n}_contains"] = typed(r["contains"], T.StringType())
        slots[f"_s_{n}_is_null"] = typed(r["is_null"], T.BooleanType())
    rows = rows.withColumns(slots)
    fields, misfits = [], []
    for n in names:
        s = {op: F.col(f"_s_{n}_{op}") for op in OPERATORS}
        void = {op: F.col(f"_n_{n}_{op}") for op in _COMPARED}
        r = {op: F.col(f"_r_{n}_{op}").isNotNull() for op in OPERATORS}
        text = isinstance(schema[n].dataType, T.StringType)
        bad = [r[op] & s[op].isNull() & ~void[op] for op in _COMPARED]
        for op in ("in", "not_in"):
            bad += [r[op] & (F.coalesce(F.size(s[op]), F.lit(0)) <= 0),
                    F.exists(s[op], lambda x: x["v"].isNull() & ~x["void"])]
        bad += [r["contains"] & (s["contains"].isNull() if text else F.lit(True)),
                r["is_null"] & s["is_null"].isNull(),
                F.col(f"_o_{n}") & F.exists(members(f"_v_{n}"), lambda k: ~k.isin(*OPERATORS))]
        misfits.append(F.when(_any(bad), F.lit(n)))
        # Equality with null asks for missing values; an order comparison with it holds nowhere.
        asks = [F.when(void["eq"], True), F.when(void["ne"], False), s["is_null"]]
        missing = F.coalesce(*asks)
        never = _any([void[op] for op in _COMPARED[2:]] + [a != missing for a in asks])
        fields.append(F.struct(
            *[s[op].alias(op) for op in _COMPARED],
            *[F.transform(s[op], lambda x: x["v"]).alias(op) for op in ("in", "not_in")],
            F.lower(s["contains"]).alias("contains"), missing.alias("missing"),
            never.alias("never")).alias(n))
    unknown = F.filter(F.coalesce(members(filters), F.array().cast("array<string>")),
                       lambda k: ~k.isin(*names) if names else F.lit(True))
    wrong = F.array_compact(F.array(*misfits)).cast("array<string>")
    return rows.select(*given, F.struct(*fields).alias("conds"),
                       F.array_sort(F.concat(unknown, wrong)).alias("misfits"))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))


def slots_of(schema: T.StructType, name: str) -> list[str]:
    """Slots of a field's conditions that :func:`holds` tests."""
    text = ["contains"] if isinstance(schema[name].dataType, T.StringType) else []
    return [*_COMPARED, "in", "not_in", "missing", *text, "never"]


def holds(slots: Column, schema: T.StructType, names: list[str],
          value_of: Callable[[str], Column], filled: Mapping[str, Collection[str]] | None = None
          ) -> Column:
    """Whether a row satisfies the conditions; ``value_of(name)`` gives its value of a field. An
    empty slot asks for nothing. ``filled`` names the slots that are not empty in every request, if
    that is known: the others are not looked at."""
    tests = []
    for name in names:
        asked = slots_of(schema, name) if filled is None else filled[name]
        x, s = value_of(name).cast(comparand_type(schema[name].dataType)), slots[name]
        compared = {"eq": x == s["eq"], "ne": x != s["ne"], "gt": x > s["gt"],
                    "gte": x >= s["gte"], "lt": x < s["lt"], "lte": x <= s["lte"],
                    "in": F.array_contains(s["in"], x), "not_in": ~F.array_contains(s["not_in"], x),
                    "missing": x.isNull() == s["missing"]}
        if isinstance(schema[name].dataType, T.StringType):
            compared["contains"] = F.contains(F.lower(x), s["contains"])
        tests += [s[op].isNull() | F.coalesce(test, F.lit(False)) for op, test in compared.items()
                  if op in asked]
        tests += [~s["never"]] if "never" in asked else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))
