"""Submissions run together against the same submissions run one by one."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks.fixtures import CUSTOMER, ORDERS, customers, orders
from swathe.model import ActionSpec
from swathe.plans.arrivals import compile_requests, run_arrivals, with_changes
from swathe.plans.bulk import run_action
from swathe.sources.staging import stage
from swathe.streaming import apply
from tests.conftest import SF

SCHEMA = ("action_id string, account_id string, action_type string, configuration string, "
          "batch_size int, created_at timestamp_ntz")


def draw_requests(seed, accounts, n):
    draw, out = random.Random(seed), []
    for i in range(n):
        action = draw.choice(["update", "update", "update", "delete", "archive", "tag"])
        params = {}
        if action == "update":
            params["updates"] = draw.choice([
                {"o_orderstatus": draw.choice("XY")}, {"o_orderstatus": "F", "o_totalprice": 2.5},
                {"o_custkey": draw.randint(0, 5)}, {"o_orderdate": None}])
        if action == "delete" and draw.random() < 0.7:
            params["hard"] = draw.random() < 0.5
        if action == "archive":
            params |= {"column": "o_orderstatus", "status": draw.choice("ZY")}
        if action == "tag":
            params |= {"column": "o_orderstatus", "suffix": "+"}
        ids = [draw.randrange(300) for _ in range(30)] if draw.random() < 0.3 else None
        filters = None if ids else draw.choice([
            {}, {"o_orderstatus": draw.choice("FOPXY")}, {"o_totalprice": {"gte": draw.randint(0, 300_000)}},
            {"o_orderstatus": {"in": ["O", "X"]}, "o_custkey": {"lt": draw.randint(0, 150)}},
            {"o_orderdate": {"lt": "1997-01-01 00:00:00"}}, {"o_custkey": draw.randint(0, 9)},
            {"o_orderstatus": {"contains": "x"}}, {"o_orderdate": {"eq": None}},
            {"o_orderdate": {"is_null": False}, "o_orderstatus": {"ne": "P"}},
            {"o_custkey": {"not_in": [1, 2, 3]}, "o_totalprice": {"gt": None}}])
        out.append((f"a{i}", draw.choice(accounts), action, params, filters, ids,
                    "o_custkey" if draw.random() < 0.25 else None, draw.choice([None, 7, 20]),
                    datetime(2024, 1, 1) + timedelta(minutes=i)))
    return out


def submitted(spark, requests):
    rows = []
    for action_id, account, action, params, filters, ids, dedup, size, at in requests:
        body = dict(params) | ({"filter": filters} if filters is not None else {"entity_ids": ids})
        if dedup:
            body["deduplicate_by"] = dedup
        rows.append((action_id, account, action, json.dumps(body), size, at))
    return spark.createDataFrame(rows, SCHEMA)


OUTCOME = ["action_id", "batch_index", "entity_id", "status", "reason_code", "message", "details"]
BATCH = ["action_id", "batch_index", "cursor_start", "cursor_end", "entity_count",
         "success_count", "skipped_count", "processed_count"]


def bag(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_together_equals_one_by_one(spark, tmp_path):
    table = stage(orders(spark, SF).where("o_orderkey < 250"), "few")
    accounts = [r[0] for r in table.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    requests = draw_requests(5, accounts[:2], 14)
    outcomes, batches, stats, current = [], [], {}, table
    for action_id, account, action, params, filters, ids, dedup, size, at in requests:
        one = run_action(current, ORDERS, ActionSpec(action, account, filters, ids, dedup, size,
                                                     params, action_id), at,
                         started_at=at, finished_at=at)
        outcomes += bag(one.outcomes, OUTCOME)
        batches += bag(one.batches, BATCH)
        stats[action_id] = one.stats.first().asDict()
        current = stage(one.table, "one")
    want = bag(current, table.columns)

    both = run_arrivals(table, ORDERS, submitted(spark, requests))
    assert bag(both.outcomes, OUTCOME) == sorted(outcomes, key=str)
    assert bag(both.batches, BATCH) == sorted(batches, key=str)
    got = {r.action_id: {k: v for k, v in r.asDict().items() if k != "account_id"}
           for r in both.stats.collect()}
    assert got == stats
    assert bag(with_changes(table, ORDERS, both.changes), table.columns) == want
    assert both.rejected.count() == 0
    dup = {(r.action_id, r.winner_pk) for r in both.claims.collect()}
    assert dup == {(a, e) for a, _, e, s, r, *_ in outcomes if r in ("updated", "deleted", "no_change")
                   and any(q[0] == a and q[6] for q in requests) and e is not None}

    # The same in three triggers, of which the second is delivered twice.
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    step = apply.arrivals_step(table, ORDERS, out, state)
    for trigger in (0, 1, 1, 2):
        step(submitted(spark, requests[5 * trigger:5 * trigger + 5]), trigger)
    assert bag(spark.read.parquet(f"{out}/outcomes"), OUTCOME) == sorted(outcomes, key=str)
    changes = apply.arrivals_changes(spark, state, ORDERS)
    assert bag(with_changes(table, ORDERS, changes), table.columns) == want


def test_refused_requests(spark):
    bad = {
        "json": "{", "list": "[1]", "none": '{"updates":{"c_name":"x"}}',
        "two": '{"updates":{"c_name":"x"},"filter":{},"entity_ids":[1]}',
        "field": '{"updates":{"c_name":"x"},"filter":{"zip":1}}',
        "operator": '{"updates":{"c_name":"x"},"filter":{"c_name":{"like":"x"}}}',
        "number": '{"updates":{"c_name":"x"},"filter":{"c_acctbal":{"gt":"much"}}}',
        "text": '{"updates":{"c_name":"x"},"filter":{"c_name":5}}',
        "empty": '{"updates":{"c_name":"x"},"filter":{"c_name":{"in":[]}}}',
        "scalar": '{"updates":{"c_name":"x"},"filter":{"c_name":{"in":"x"}}}',
        "element": '{"updates":{"c_name":"x"},"filter":{"c_name":{"in":["x",1]}}}',
        "contains": '{"updates":{"c_name":"x"},"filter":{"c_acctbal":{"contains":"1"}}}',
        "update": '{"updates":{"zip":"x"},"filter":{}}', "value": '{"updates":{"c_acctbal":1e9},"filter":{}}',
        "kind": '{"updates":{"c_name":5},"filter":{}}', "dedup": '{"updates":{"c_name":"x"},"filter":{},"deduplicate_by":"c_name"}'}
    rows = [(k, "1", "update", v, None, datetime(2024, 1, 1)) for k, v in bad.items()]
    rows += [("other", "1", "birthday", '{"filter":{}}', None, datetime(2024, 1, 1)),
             ("good", "1", "update", '{"updates":{"c_name":" x "},"filter":{"c_acctbal":{"lt":null},'
              '"c_name":{"in":["a",null]}}}', None, datetime(2024, 1, 1))]
    found = compile_requests(spark.createDataFrame(rows, SCHEMA), CUSTOMER,
                             customers(spark, SF).schema)
    errors = {r.action_id: r.errors for r in found.collect()}
    assert errors.pop("good") == []
    assert all(errors.values()) and set(errors) == {*bad, "other"}
    assert errors["number"] == ["filter:c_acctbal"] and errors["field"] == ["filter:zip"]
    assert errors["value"] == ["c_acctbal:above_maximum"] and errors["kind"] == ["c_name:not_a_string"]
    row = found.where("action_id = 'good'").select("effects.c_name", "conds.c_acctbal.never").first()
    assert row.c_name.value == "x" and row.never


def test_index_narrows_what_rows_meet(spark):
    """Requests for a value of an unwritten field are not met by other rows at all."""
    from swathe.plans.arrivals import _by_account, _numbered

    rows = [(f"a{i}", "1-URGENT", "update", json.dumps(
        {"updates": {"o_totalprice": 1.0}, "filter": {"o_custkey": i}}), None, datetime(2024, 1, 1))
        for i in range(40)]
    rows.append(("all", "1-URGENT", "delete", '{"filter":{}}', None, datetime(2024, 1, 2)))
    schema = orders(spark, SF).schema
    compiled = stage(_numbered(compile_requests(spark.createDataFrame(rows, SCHEMA), ORDERS, schema),
                               ["created_at"]), "requests")
    found = _by_account(compiled, ORDERS, schema).first()
    assert len(found["_requests"]) == 41 and found["_every"] == [40]
    assert len(found["_index_o_custkey"]) == 40


def test_rows_are_tested_for_what_a_round_asks_only(spark):
    """The fold of a row holds no test and no effect that no request of the round has."""
    from swathe.plans.arrivals import _by_account, _fold, _numbered, _slots

    rows = [("a", "1-URGENT", "update", '{"updates":{"o_totalprice":1},"filter":{"o_custkey":{"gte":7}}}',
             None, datetime(2024, 1, 1)),
            ("b", "1-URGENT", "delete", '{"filter":{"o_orderdate":{"eq":null}},"deduplicate_by":"o_custkey"}',
             None, datetime(2024, 1, 2)),
            ("c", "1-URGENT", "tag", '{"suffix":"+","column":"o_orderstatus","filter":{"o_orderstatus":"F"}}',
             None, datetime(2024, 1, 3))]
    table = orders(spark, SF)
    compiled = stage(_numbered(compile_requests(spark.createDataFrame(rows, SCHEMA), ORDERS, table.schema),
                               ["created_at"]), "requests")
    first, second = _slots(compiled, ORDERS, table.schema)
    assert {n: set(s) for n, s in first.asked.items() if s} == {
        "o_custkey": {"gte"}, "o_orderdate": {"missing"}}
    assert first.given == {"o_totalprice"} and not first.suffixed and first.soft
    assert {n: set(s) for n, s in second.asked.items() if s} == {"o_orderstatus": {"eq"}}
    assert second.suffixed == {"o_orderstatus"} and not second.given and not second.soft
    accounts = _by_account(compiled.where("round = 0"), ORDERS, table.schema, first)
    joined = table.withColumn("_named", F.lit(None).cast("array<int>")).join(
        accounts, F.col("o_orderpriority") == F.col("account"))
    plan = _fold(joined, ORDERS, table.schema, first)._jdf.queryExecution().optimizedPlan().toString()
    assert "contains" not in plan and "not_in" not in plan.split("aggregate(")[1].split("\n")[0]


def test_nothing_to_run(spark):
    table = orders(spark, SF)
    none = spark.createDataFrame([], SCHEMA)
    done = run_arrivals(table, ORDERS, none)
    assert done.outcomes.count() == done.batches.count() == done.stats.count() == 0
    assert with_changes(table, ORDERS, done.changes).count() == table.count()
    assert run_arrivals(table.limit(0), ORDERS, submitted(spark, draw_requests(1, ["1-URGENT"], 3))
                        ).stats.agg(F.sum("success_count")).first()[0] == 0
