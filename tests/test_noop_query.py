"""The query of rows that an update of two fields leaves alone."""

from __future__ import annotations

from datetime import datetime

from checks.q_actions import update_noop


def test_both_fields_count(spark, tmp_path):
    other, day = datetime(1996, 1, 1), datetime(1998, 5, 5)
    spark.createDataFrame(
        [(1, 5, "O", 10.0, day, "5-LOW"), (2, 5, "O", 10.0, other, "5-LOW"),
         (3, 5, "F", 10.0, day, "5-LOW"), (4, 5, "O", 10.0, day, "1-URGENT")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.entity_id for r in update_noop(spark, str(tmp_path)).collect()] == [1]
