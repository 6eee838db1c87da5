"""Everything an action leaves behind, written so that doing it again changes nothing."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathe.plans.bulk import ActionResult, numbered_outcomes
from swathe.sources.store import Store
from swathe.sources.tables import latest_version, path_exists, replace_outcomes, write_version


def publish(result: ActionResult, root: str, version: int) -> None:
    """Write an action's audit rows, batches, statistics, claimed keys and new table version below
    ``root``.

    Control tables keep one folder per action, which a repeated run replaces. The table version is
    written last and readers only see complete versions, so a job that dies halfway leaves the
    previous version in force and can simply be run again.
    """
    replace_outcomes(numbered_outcomes(result.outcomes), f"{root}/outcomes")
    replace_outcomes(result.batches, f"{root}/batches")
    replace_outcomes(result.stats.withColumns({
        "failure_breakdown": F.to_json("failure_breakdown"),
        "skip_breakdown": F.to_json("skip_breakdown")}), f"{root}/stats")
    if result.ledger is not None:
        result.ledger.write.mode("append").partitionBy("action_id").parquet(f"{root}/ledger")
    write_version(result.table, f"{root}/table", version)
    result.release()


def commit(result: ActionResult, store: Store, base: int, note: Mapping[str, Any] | None = None
           ) -> int | None:
    """As :func:`publish` for a store, of whose version ``base`` the result was made: only files
    with a changed row are written, and table, audit rows, batches, statistics and claimed keys
    become visible together. None if another commit came first; run the action again then."""
    parts = {"outcomes": numbered_outcomes(result.outcomes), "batches": result.batches,
             "stats": result.stats}
    if result.ledger is not None:
        parts["ledger"] = result.ledger
    number = store.change(result.changed, result.rewrite, parts, note, base)
    result.release()
    return number


def claimed_before(spark, root: str) -> DataFrame | None:
    """Ledger of earlier runs, to be given to :func:`swathe.plans.bulk.run_action`."""
    path = f"{root}/ledger"
    return spark.read.parquet(path) if path_exists(spark, path) else None


def next_version(spark, root: str) -> int:
    current = latest_version(spark, f"{root}/table")
    return 1 if current is None else current + 1
