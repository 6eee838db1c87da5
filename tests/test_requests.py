"""Declarations, filters, registries: requests are refused before anything runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from swathe.functions.measures import batch_size_of, effective_batch_size
from swathe.functions.predicates import compile_filter
from swathe.functions.text import normalise_key
from swathe.model import (
    COMPANY,
    CONTACT,
    ActionSpec,
    EntitySpec,
    FieldRule,
    RequestError,
    all_entities,
    get_entity,
    register_entity,
)
from swathe.operators.actions import (
    Mutation,
    all_actions,
    check_spec,
    entity_action_matrix,
    get_action,
    register_action,
)

COLUMNS = ["id", "account_id", "name", "email", "age", "status", "created_at", "updated_at",
           "deleted_at"]


def spec(**changes):
    return ActionSpec(**{**dict(action="update", account=1, filter={},
                                params={"updates": {"status": "x"}}), **changes})


def test_values_are_coerced_and_only_given_fields_return():
    assert CONTACT.coerce_updates({"age": " 42.0 "}) == {"age": 42}
    assert CONTACT.coerce_updates({"age": "42"}) == {"age": 42}
    assert CONTACT.coerce_updates({"status": "  churned "}) == {"status": "churned"}
    assert CONTACT.coerce_updates({"age": None}) == {"age": None}


@pytest.mark.parametrize(("updates", "error"), [
    ({"age": 900}, {"field": "age", "error": "above_maximum"}),
    ({"age": "4.5"}, {"field": "age", "error": "not_a_number"}),
    ({"age": []}, {"field": "age", "error": "not_a_number"}),
    ({"age": 4.5}, {"field": "age", "error": "not_a_number"}),
    ({"email": "not-an-email"}, {"field": "email", "error": "pattern_mismatch"}),
    ({"name": "  "}, {"field": "name", "error": "too_short"}),
    ({"status": None}, {"field": "status", "error": "null_not_allowed"}),
    ({"nickname": "Ada"}, {"field": "nickname", "error": "not_updatable"}),
    ({}, {"field": "updates", "error": "empty"}),
])
def test_bad_values_are_refused(updates, error):
    with pytest.raises(RequestError) as exc:
        CONTACT.coerce_updates(updates)
    assert error in exc.value.errors


@pytest.mark.parametrize("value", [
    "42", " 7.0 ", "-1", "151", "x", "4.5", "", None])
def test_one_request_and_a_table_of_requests_agree(spark, value):
    from swathe.functions.rules import field_error
    rule = CONTACT.fields["age"]
    try:
        rule.coerce(value)
        want = None
    except ValueError as exc:
        want = str(exc)
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(field_error(F.col("v"), rule)).first()[0] == want


def test_timestamps_are_checked():
    rule = FieldRule("timestamp")
    assert rule.coerce("2024-01-01T10:00:00") == "2024-01-01 10:00:00"
    with pytest.raises(ValueError, match="not_a_timestamp"):
        rule.coerce("soon")


@pytest.mark.parametrize("changes", [
    {"filter": None},
    {"ids": [1]},
    {"filter": None, "ids": []},
    {"dedup_by": "name"},
    {"params": {"updates": {"status": "x"}, "hardly": True}},
    {"params": {}},
    {"filter": {"salary": 100}},
    {"filter": {"age": {"approximately": 30}}},
    {"action": "teleport"},
])
def test_bad_requests_are_refused(changes):
    with pytest.raises(RequestError):
        check_spec(CONTACT, spec(**changes), COLUMNS)


def test_good_requests_pass():
    assert check_spec(CONTACT, spec(dedup_by="email"), COLUMNS)["updates"] == {"status": "x"}
    check_spec(COMPANY, spec(dedup_by="domain"), COLUMNS)
    check_spec(CONTACT, spec(filter={"created_at": {"gt": "2024-01-01"}}), COLUMNS)


def test_soft_delete_needs_a_column():
    bare = EntitySpec("bare", {"name": FieldRule()}, soft_delete=None)
    with pytest.raises(RequestError):
        check_spec(bare, spec(action="delete", params={}), COLUMNS)
    check_spec(bare, spec(action="delete", params={"hard": True}), COLUMNS)


def test_filters(spark):
    df = spark.createDataFrame(
        [("1", 1, "Ada 100%", "ada@x.org", 30, "active"), ("2", 1, "Bob", "b@x.org", None, "new")],
        "id string, account_id int, name string, email string, age int, status string")

    def ids(filters):
        return sorted(r.id for r in df.where(compile_filter(CONTACT, filters, df)).collect())

    assert ids({}) == ids(None) == ids({"age": {}}) == ["1", "2"]
    assert ids({"age": {"gte": "30", "lt": 30.5}}) == ["1"]
    assert ids({"age": None}) == ["2"] and ids({"age": {"ne": None}}) == ["1"]
    assert ids({"age": {"ne": 5}}) == ["1"]
    assert ids({"age": {"gt": None}}) == []
    assert ids({"age": {"not_in": [5, 6]}}) == ["1"]
    assert ids({"name": {"contains": "100%"}}) == ["1"]
    assert ids({"name": {"contains": "A_A"}}) == []
    assert ids({"age": {"is_null": 0}}) == ["1"]
    assert ids({"status": "active'; DROP TABLE contacts; --"}) == []
    for bad in ({"status": {"in": []}}, {"status": {"in": "active"}}, {"age": "old"},
                {"age": {"contains": "3"}}, {"status": 5}, {"salary": 1}):
        with pytest.raises(RequestError):
            compile_filter(CONTACT, bad, df)


def test_filter_reaches_the_scan(spark):
    from checks.fixtures import ORDERS, table
    df = table(spark, "/root/testdata/sf0.001", "orders")
    out = df.where(compile_filter(ORDERS, {"o_custkey": {"gte": "7"}, "o_orderstatus": "P"}, df))
    query = out.select("o_orderkey")._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(query, "formatted")
    assert "GreaterThanOrEqual(o_custkey,7)" in plan and "EqualTo(o_orderstatus,P)" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(("requested", "limit", "want"), [
    (None, 10_000, 1000), (5000, 600, 600), (999_999, 10_000_000, 10_000), (0, 10_000, 1000),
    (10, 0, 1)])
def test_batch_size(spark, requested, limit, want):
    assert batch_size_of(requested, limit) == want
    size = effective_batch_size(F.lit(requested).cast("int"), F.lit(limit))
    assert spark.range(1).select(size).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [
    ("  Ada@Example.COM ", "ada@example.com"), ("ada@example.com", "ada@example.com"),
    ("", None), ("   ", None), (None, None), ("  x　\x1f", "x")])
def test_normalise(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(normalise_key("v")).first()[0] == want


def test_registries(spark):
    assert {"contact", "company"} <= set(all_entities())
    assert {"update", "delete", "archive", "tag"} <= set(all_actions())
    assert get_entity(" Contact ") is CONTACT
    for lookup, known in ((get_entity, "contact"), (get_action, "update")):
        with pytest.raises(RequestError, match=known):
            lookup("unicorn")
    with pytest.raises(RuntimeError, match="already registered"):
        register_entity(CONTACT)
    with pytest.raises(RuntimeError, match="already registered"):
        register_action("update")(lambda *a: Mutation())


def test_matrix_is_the_full_product_of_what_is_supported(spark):
    register_action("only_contacts", supports=("contact",))(lambda *a: Mutation())
    pairs = {tuple(r) for r in entity_action_matrix(spark).collect()}
    assert {("contact", "update"), ("contact", "delete"), ("company", "update"),
            ("company", "delete"), ("contact", "only_contacts")} <= pairs
    assert ("company", "only_contacts") not in pairs
    with pytest.raises(RequestError):
        get_action("only_contacts", "company")
