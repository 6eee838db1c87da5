"""Applying a mutation to a table, and deleting along foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathe.model import EntitySpec
from swathe.operators.actions import Mutation
from swathe.sources.staging import stage


def mutate(df: DataFrame, entity: EntitySpec, mutation: Mutation, chosen: Column,
           as_of: Any) -> DataFrame:
    """New version of ``df``: rows with ``chosen`` true are changed or removed, all others kept.

    ``chosen`` is a plain row expression, so this is one projection or filter over the scan.
    """
    chosen = F.coalesce(chosen, F.lit(False))
    if mutation.remove:
        return df.where(~chosen)
    assign = dict(mutation.assign)
    if mutation.stamp and entity.updated_at and entity.updated_at in df.columns:
        assign[entity.updated_at] = F.col("_as_of")
    types = {f.name: f.dataType for f in df.schema}
    return (df.withColumn("_as_of", F.lit(as_of))
            .select(*[F.when(chosen, assign[c].cast(types[c])).otherwise(F.col(c)).alias(c)
                      if c in assign else F.col(c) for c in df.columns]))


def mutate_keys(df: DataFrame, entity: EntitySpec, mutation: Mutation, keys: DataFrame,
                account: Any, as_of: Any) -> DataFrame:
    """As :func:`mutate` for an explicit set of keys of one account.

    Only the account's rows take part in the join; everything else passes straight through.
    """
    ours = F.col(entity.account).eqNullSafe(F.lit(account))
    slice_, rest = df.where(ours), df.where(~ours)
    return account_slice(slice_, entity, mutation, keys, as_of).unionByName(rest)


def account_slice(slice_: DataFrame, entity: EntitySpec, mutation: Mutation, keys: DataFrame,
                  as_of: Any) -> DataFrame:
    keys = keys.select(F.col(entity.pk).alias("_hit"))
    if mutation.remove:
        return slice_.join(keys, F.col(entity.pk) == F.col("_hit"), "left_anti")
    joined = slice_.join(keys, F.col(entity.pk) == F.col("_hit"), "left")
    return mutate(joined, entity, mutation, F.col("_hit").isNotNull(), as_of).drop("_hit")


@dataclass(frozen=True)
class Reference:
    """``child.column`` holds the key of a row of ``parent``; removing that row removes the child's
    row, or with ``clear`` empties the column."""

    child: str
    column: str
    parent: str
    clear: bool = False


def cascade(tables: Mapping[str, DataFrame], keys: Mapping[str, str],
            references: Sequence[Reference], doomed: Mapping[str, DataFrame]
            ) -> dict[str, DataFrame]:
    """Remove ``doomed`` rows (a one-column table of keys per table name) and all that hangs on them.

    A table may have several parents, be its own parent and stand in cycles: removed keys spread
    from the parents that lost rows in the step before until no table loses more. Keys are found and
    written once, when their row is first removed. ``keys`` names the key column of the tables
    that others refer to. Null references hang on nothing.
    """
    parents = {r.parent for r in references}
    gone: dict[str, list[DataFrame]] = {name: [] for name in tables}
    fresh = {name: rows.select(F.col(rows.columns[0]).alias("_gone")).where(
        "_gone IS NOT NULL").distinct() for name, rows in doomed.items()}
    while fresh:
        for name, rows in fresh.items():
            gone[name].append(stage(rows, f"gone-{name}"))
        last = {name: gone[name][-1] for name in fresh if name in parents}
        found: dict[str, DataFrame] = {}
        for r in references:
            if r.parent in last and r.child in parents and not r.clear:
                hit = tables[r.child].join(last[r.parent], F.col(r.column) == F.col("_gone"),
                                           "left_semi").select(F.col(keys[r.child]).alias("_gone"))
                found[r.child] = found[r.child].unionByName(hit) if r.child in found else hit
        fresh = {}
        for name, rows in found.items():
            new = rows.where("_gone IS NOT NULL").distinct()
            for known in gone[name]:
                new = new.join(known, "_gone", "left_anti")
            new = stage(new, f"gone-{name}")
            if not new.isEmpty():
                fresh[name] = new
    out = {}
    for name, table in tables.items():
        for rows in gone[name]:
            table = table.join(rows, F.col(keys[name]) == F.col("_gone"), "left_anti")
        for r in (r for r in references if r.child == name and gone[r.parent]):
            removed = reduce(DataFrame.unionByName, gone[r.parent])
            hangs = F.col(r.column) == F.col("_gone")
            if r.clear:
                table = table.join(removed, hangs, "left").withColumn(
                    r.column, F.when(F.col("_gone").isNull(), F.col(r.column))).drop("_gone")
            elif name not in parents:  # of others the rows are known by their keys
                table = table.join(removed, hangs, "left_anti")
        out[name] = table
    return out


def cascade_delete(root: DataFrame, key: str, doomed: DataFrame,
                   children: Sequence[tuple[str, DataFrame, str, str | None, str]]
                   ) -> Mapping[str, DataFrame]:
    """:func:`cascade` from one table: ``children`` lists ``(name, table, foreign_key, own_key,
    parent)``, a table once per parent, with ``"root"`` naming the root; ``own_key`` is None for
    tables nothing refers to. Returns the remaining tables by name."""
    tables, keys = {"root": root}, {"root": key}
    for name, table, _, own_key, _ in children:
        tables[name] = table
        if own_key is not None:
            keys[name] = own_key
    return cascade(tables, keys, [Reference(name, column, parent)
                                  for name, _, column, _, parent in children], {"root": doomed})


def apply_changes(table: DataFrame, changes: DataFrame, key: str,
                  columns: Sequence[str]) -> DataFrame:
    """Control-table update by key: a change row's non-null columns replace the stored ones."""
    renamed = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}")
                                                         for c in columns])
    joined = table.join(renamed, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
                           if c in columns else F.col(c) for c in table.columns])
