"""Acceptance of whole tables of requests, against a one-by-one model."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from swathe.operators.submissions import accept_submissions, error_text, validate_submissions
from tests.models import sequential_bucket

GOOD = json.dumps({"filter": {}, "updates": {"status": "x"}})
SCHEMA = ("id int, account_id int, entity_type string, action_type string, payload string, "
          "batch_size int, idempotency_key string, scheduled_at timestamp, ms bigint")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "timestamp_millis(ms) AS created_at")


def accounts(spark):
    return spark.createDataFrame([(i, 50) for i in range(4)],
                                 "account_id int, rate_limit_per_minute int")


def one_by_one(rows, limit, stored):
    """Decisions of valid requests, request after request."""
    holders, tried, out = dict(stored), {}, {}
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        key = (r[1], r[6]) if r[6] else None
        if key in holders:
            out[r[0]] = ("replayed", holders[key])
            continue
        past = tried.setdefault(r[1], [])
        past.append((r[8], 1, limit))
        ok = sequential_bucket(past, 60_000)[-1][0]
        out[r[0]] = ("accepted" if ok else "rate_limited", None)
        if ok and key:
            holders[key] = r[0]
    return out


def test_acceptance_equals_one_by_one(spark):
    rng = random.Random(3)
    rows, clock = [], 0
    for i in range(160):
        clock += rng.choice([100, 3_000, 9_000, 20_000])
        rows.append((i, rng.choice([0, 0, 0, 1, 2]), " Contact", "UPDATE", GOOD, 500,
                     rng.choice([None, "", "k1", "k2", "k3", "k4", "k5"]), None, clock))
    stored = spark.createDataFrame([(-1, 0, "k5"), (-2, 1, None)],
                                   "id int, account_id int, idempotency_key string")
    want = one_by_one(rows, 2, {(0, "k5"): -1})
    assert {w[0] for w in want.values()} == {"accepted", "replayed", "rate_limited"}
    out = accept_submissions(frame(spark, rows), accounts(spark), stored, per_minute=2).collect()
    assert {r.id: (r.decision, r.replay_of) for r in out} == want
    assert len(out) == len(rows)
    for r in out:
        assert (r.effective_batch_size == 50) == (r.decision == "accepted")
        assert (r.status == "queued") == (r.decision == "accepted")
        assert (r.retry_after_seconds or 0) > 0 if r.decision == "rate_limited" else True


def test_validation_names_every_problem(spark):
    def row(i, **c):
        base = dict(account=1, entity="contact", action="update", payload=GOOD, size=10, key=None,
                    at=None)
        base.update(c)
        return (i, base["account"], base["entity"], base["action"], base["payload"], base["size"],
                base["key"], base["at"], 1_000)

    cases = [
        (row(0), ""),
        (row(1, account=99), "account_id:unknown_account"),
        (row(2, entity="unicorn"), "entity_type:unknown_entity"),
        (row(3, action="teleport"), "action_type:unknown_action"),
        (row(4, payload="[1]"), "payload:not_an_object"),
        (row(5, payload='{"filter":{},"updates":{"a":1},"hardly":1}'), "payload:unknown_key"),
        (row(6, payload='{"filter":null,"updates":{"a":1}}'), "filter:no_target_set"),
        (row(7, payload='{"filter":{},"entity_ids":[1],"updates":{"a":1}}'),
         "filter:two_target_sets"),
        (row(8, size=10_001, key="k" * 256),
         "batch_size:out_of_range;idempotency_key:too_long"),
        (row(9, payload='{"filter":{},"updates":{"a":1},"deduplicate_by":"name"}'),
         "deduplicate_by:not_a_dedup_field"),
        (row(10, payload='{"filter":{}}'), "payload:missing_key"),
        (row(11, payload='{"filter":{},"updates":{}}'), "updates:empty"),
        (row(12, action="delete", payload='{"entity_ids":[]}'), "entity_ids:empty"),
        (row(13, entity="company", action=" Delete ", payload='{"filter":{},"hard":true}'), ""),
    ]
    df = validate_submissions(frame(spark, [c for c, _ in cases]), accounts(spark))
    got = {r.id: r.e for r in df.select("id", error_text().alias("e")).collect()}
    assert got == {c[0]: e for c, e in cases}


def test_an_actions_own_check_runs_over_a_table(spark, monkeypatch):
    """What an action says about its payload becomes an error of the request."""
    from swathe.operators import actions, submissions

    def errors(payload):
        level = F.try_variant_get(payload, "$.level", "int")
        return [("level", F.when(~F.coalesce(level.between(1, 9), F.lit(False)), "not_1_to_9"))]

    grade = actions.Action("grade", lambda *_: None, params=("level",), column_check=errors)
    monkeypatch.setitem(actions._actions, "grade", grade)
    rows = [(i, "contact", "grade", p, 1, 10, None, None, None) for i, p in enumerate(
        ['{"filter":{},"level":3}', '{"filter":{},"level":12}', '{"filter":{}}', '{"level":3}'])]
    rows.append((9, "contact", "tag", '{"filter":{},"suffix":7}', 1, 10, None, None, None))
    asked = spark.createDataFrame(rows, "id int, entity_type string, action_type string, payload string, "
                                  "account_id int, batch_size int, idempotency_key string, "
                                  "scheduled_at timestamp, created_at timestamp")
    known = spark.createDataFrame([(1,)], "account_id int")
    found = {r.id: [(e.field, e.error) for e in r.errors]
             for r in submissions.validate_submissions(asked, known).collect()}
    assert found == {0: [], 1: [("level", "not_1_to_9")], 2: [("level", "not_1_to_9")],
                     3: [("filter", "no_target_set")], 9: [("suffix", "length")]}
