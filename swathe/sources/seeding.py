"""Demo rows for any declared entity, generated in parallel and reproducible."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swathe.model import NUMERIC_TYPES, EntitySpec, FieldRule

# --- The vocabulary of generated rows --------------------------------------------------------
FIRST_NAMES = ("Amber", "Basil", "Coral", "Dusty", "Ebony", "Flint", "Ginger", "Hazel", "Ivory",
               "Jasper", "Olive", "Rusty", "Scarlet")
LAST_NAMES = ("Birchwood", "Clearwater", "Dunmore", "Eastlake", "Fairbrook", "Greenfield",
              "Highcliff", "Longmeadow", "Northgate", "Stonebridge", "Westbury")
STATUSES = ("active", "inactive", "prospect", "churned")
INDUSTRIES = ("brewing", "forestry", "glassmaking", "printing", "shipbuilding")
MAIL_DOMAINS = ("lakeside.example", "meadow.example", "orchard.example", "valley.example")
COMPANY_SUFFIXES = ("com", "io", "net")
INT_RANGE = (18, 75)
CHUNK_ROWS = 5_000
# ---------------------------------------------------------------------------------------------


def draw(index: Column, salt: str) -> Column:
    """Uniform integer below 2**28 from a row number and a salt (md5, so any engine can repeat
    it)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), index.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")


def pick(values: tuple[str, ...], index: Column, salt: str) -> Column:
    at = (draw(index, salt) % len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


# What a declaration's ``sample`` may name in braces, besides ``row``.
WORDS = {"given": FIRST_NAMES, "last": LAST_NAMES, "status": STATUSES, "industry": INDUSTRIES,
         "domain": MAIL_DOMAINS, "suffix": COMPANY_SUFFIXES}


def filled(sample: str, index: Column, salt: str) -> Column:
    """A text pattern for one row: ``{row}`` is the row's number, ``{list}`` a word drawn from
    ``WORDS``, ``{list:lower}`` that in lower case; all else stands as it is. The first draw uses
    ``salt`` itself, later ones also the list's name, so that draws are independent."""
    parts, drawn = [], 0
    for number, piece in enumerate(re.split(r"\{(.*?)\}", sample)):
        if number % 2 == 0:
            parts.append(F.lit(piece))
        elif piece == "row":
            parts.append(index.cast("string"))
        else:
            words, _, form = piece.partition(":")
            word = pick(WORDS[words], index, f"{salt}:{words}" if drawn else salt)
            parts.append(F.lower(word) if form == "lower" else word)
            drawn += 1
    return F.concat(*parts)


def seed_value(name: str, rule: FieldRule, index: Column, seed: int) -> Column:
    """A value as the field's declaration describes it: ``sample`` is a text pattern, or for a
    number its range. Without one, texts are numbered and numbers come from ``INT_RANGE``."""
    salt = f"{seed}:{name}"
    if rule.type in NUMERIC_TYPES:
        low, high = map(int, rule.sample.split("..")) if rule.sample else INT_RANGE
        return (low + draw(index, salt) % (high - low + 1)).cast(rule.type)
    return filled(rule.sample or f"{name}-{{row}}", index, salt)


def seed_rows(spine: DataFrame, entity: EntitySpec, account: Any, as_of: Any,
              duplicate_ratio: float = 0.0, seed: int = 0, index: str = "row_no") -> DataFrame:
    """One entity row per row of ``spine``, whose ``index`` column numbers rows from 0.

    With ``duplicate_ratio`` p, a row reuses, with probability p, the key that an earlier row of
    its 5,000-row chunk brought in; the first row of a chunk always brings its own.
    """
    i = F.col("_i")
    rows = spine.select(F.col(index).alias("_i"))
    key_field = entity.dedup_fields[0] if entity.dedup_fields else None
    values = {n: seed_value(n, rule, i, seed) for n, rule in entity.fields.items()}
    if key_field is not None and duplicate_ratio > 0:
        rows = _key_owners(rows, duplicate_ratio, seed)
        values[key_field] = seed_value(key_field, entity.fields[key_field], F.col("_owner"), seed)
    stamp = F.lit(as_of).cast("timestamp")
    columns = {entity.pk: F.md5(F.concat(F.lit(f"{seed}:{entity.name}:"), i.cast("string"))),
               entity.account: F.lit(account), **values, "created_at": stamp}
    if entity.updated_at:
        columns[entity.updated_at] = stamp
    if entity.soft_delete:
        columns[entity.soft_delete] = F.lit(None).cast("timestamp")
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def _key_owners(rows: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Add ``_owner``: the row number whose key a row carries (its own unless it is a duplicate)."""
    i = F.col("_i")
    chunk = F.floor(i / CHUNK_ROWS).cast("bigint")
    repeats = (i % CHUNK_ROWS != 0) & (draw(i, f"{seed}:repeat") < int(ratio * (1 << 28)))
    before = (Window.partitionBy("_chunk").orderBy("_i")   # a chunk has at most 5,000 rows
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = rows.withColumns({"_chunk": chunk, "_repeat": repeats}).withColumn(
        "_minted", F.count_if(~F.col("_repeat")).over(before))
    chosen = numbered.withColumn(
        "_source", F.when(F.col("_repeat"), draw(i, f"{seed}:source") % F.col("_minted") + 1))
    minters = numbered.where(~F.col("_repeat")).select(
        F.col("_chunk").alias("_m_chunk"), F.col("_minted").alias("_m_no"),
        F.col("_i").alias("_m_i"))
    return (chosen.join(minters, (F.col("_chunk") == F.col("_m_chunk"))
                        & (F.col("_source") == F.col("_m_no")), "left")
            .select("_i", F.coalesce("_m_i", "_i").alias("_owner")))


def seed(spark: SparkSession, entity: EntitySpec, account: Any, count: int, as_of: Any,
         duplicate_ratio: float = 0.0, seed: int = 0) -> DataFrame:
    """``count`` generated rows; write them with any DataFrame writer."""
    return seed_rows(spark.range(count).withColumnRenamed("id", "row_no"), entity, account, as_of,
                     duplicate_ratio, seed)
