"""Declarations: entities, their fields, action requests and vocabularies.

Nothing here touches data. An :class:`EntitySpec` states which table columns exist, which may be
written or filtered, which identify duplicates and how rows are scoped to an account; every
operator takes the declaration plus a DataFrame, so one implementation serves every entity.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

# --- Fixed values (vocabularies, limits and codes that callers rely on) ---------------------

ACTION_STATUSES = (
    "scheduled", "queued", "planning", "processing",
    "completed", "completed_with_errors", "failed", "cancelled",
)
TERMINAL_STATUSES = ("completed", "completed_with_errors", "failed", "cancelled")
STARTABLE_STATUSES = ("queued", "scheduled", "planning")
BATCH_STATUSES = ("pending", "processing", "completed", "failed", "cancelled")
OUTCOME_STATUSES = ("success", "failed", "skipped")
REASON_CODES = (
    "updated", "deleted", "duplicate_email", "duplicate_key", "validation_failed",
    "entity_not_found", "left_target_set", "no_change", "action_cancelled", "batch_error",
)

DEFAULT_BATCH_SIZE = 1_000
MAX_BATCH_SIZE = 10_000
DEFAULT_RATE_LIMIT_PER_MINUTE = 10_000
DEFAULT_SUBMISSIONS_PER_MINUTE = 120
MAX_RATE_LIMIT_PER_MINUTE = 10_000_000
MAX_BATCH_ATTEMPTS = 3
MAX_IDEMPOTENCY_KEY_LENGTH = 255
ACTION_ERROR_LENGTH = 2_000
OUTCOME_MESSAGE_LENGTH = 1_000
MAX_SEED_ROWS = 1_000_000
MAX_DUPLICATE_RATIO = 0.9
RETRY_CUSHION_MS = 50
IDLE_STATE_GRACE_MS = 60_000
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
COMMON_FILTER_FIELDS = ("status", "created_at", "updated_at")
# --------------------------------------------------------------------------------------------

NUMERIC_TYPES = ("int", "bigint", "double")


class RequestError(ValueError):
    """A request that must not run. ``errors`` lists ``{"field", "error"}`` entries."""

    def __init__(self, message: str, errors: list[dict[str, str]] | None = None) -> None:
        super().__init__(message)
        self.errors = errors or []


class ConflictError(RuntimeError):
    """The request contradicts the state of the action it refers to."""


@dataclass(frozen=True)
class FieldRule:
    """One declared column: its SQL type and the values an update may give it."""

    type: str = "string"
    nullable: bool = False
    filterable: bool = True
    min_length: int | None = None
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None
    pattern: str | None = None
    description: str = ""
    sample: str | None = None  # of generated rows, see swathe.sources.seeding

    def coerce(self, value: Any) -> Any:
        """Value as the declared type, or raise ``ValueError`` with the violated rule's name.

        The table-wide form of the same rules is :func:`swathe.functions.rules.field_error`.
        """
        if value is None:
            if not self.nullable:
                raise ValueError("null_not_allowed")
            return None
        if self.type == "string":
            if not isinstance(value, str):
                raise ValueError("not_a_string")
            text = value.strip()
            if self.min_length is not None and len(text) < self.min_length:
                raise ValueError("too_short")
            if self.max_length is not None and len(text) > self.max_length:
                raise ValueError("too_long")
            if self.pattern is not None and not re.search(self.pattern, text):
                raise ValueError("pattern_mismatch")
            return text
        if self.type == "timestamp":
            try:
                moment = datetime.fromisoformat(str(value).strip())
            except ValueError:
                raise ValueError("not_a_timestamp") from None
            if moment.tzinfo is not None:  # zone-less values are UTC
                moment = moment.astimezone(UTC).replace(tzinfo=None)
            return moment.isoformat(sep=" ")
        if self.type not in NUMERIC_TYPES:
            return value
        try:
            number = float(value) if self.type == "double" else _whole(value)
        except (TypeError, ValueError):
            raise ValueError("not_a_number") from None
        if self.minimum is not None and number < self.minimum:
            raise ValueError("below_minimum")
        if self.maximum is not None and number > self.maximum:
            raise ValueError("above_maximum")
        return number


def _whole(value: Any) -> int:
    if isinstance(value, bool):
        raise ValueError(value)
    if isinstance(value, str):
        value = re.fullmatch(r"\s*([+-]?\d+)(\.0*)?\s*", value)[1]  # "42" and "42.0", not "42.5"
    elif value != int(value):
        raise ValueError(value)
    return int(value)


@dataclass(frozen=True)
class EntitySpec:
    """What the library knows about one kind of row."""

    name: str
    fields: Mapping[str, FieldRule]
    pk: str = "id"
    account: str = "account_id"
    dedup_fields: tuple[str, ...] = ()
    soft_delete: str | None = "deleted_at"
    updated_at: str | None = "updated_at"
    label: str = ""

    @property
    def columns(self) -> list[str]:
        """Columns an action reads: key, declared fields, soft-delete marker."""
        return [c for c in dict.fromkeys((self.pk, *self.fields, self.soft_delete)) if c]

    def filterable(self, table_columns: list[str]) -> list[str]:
        """Names a filter may use: filterable declared fields plus the common control columns,
        as far as the table has them."""
        declared = [n for n, rule in self.fields.items() if rule.filterable]
        return [n for n in dict.fromkeys([*declared, *COMMON_FILTER_FIELDS]) if n in table_columns]

    def coerce_updates(self, updates: Mapping[str, Any] | None) -> dict[str, Any]:
        """Check one update payload against the declaration; only the given fields come back."""
        if not updates:
            raise RequestError("An update needs at least one field.",
                               [{"field": "updates", "error": "empty"}])
        unknown = sorted(set(updates) - set(self.fields))
        if unknown:
            raise RequestError(
                f"{unknown} cannot be updated on {self.name!r}; updatable: {sorted(self.fields)}",
                [{"field": n, "error": "not_updatable"} for n in unknown])
        coerced, errors = {}, []
        for name, value in updates.items():
            try:
                coerced[name] = self.fields[name].coerce(value)
            except ValueError as exc:
                errors.append({"field": name, "error": str(exc)})
        if errors:
            raise RequestError(f"Invalid values for {self.name!r}: {errors}", errors)
        return coerced


_entities: dict[str, EntitySpec] = {}


def register_entity(spec: EntitySpec) -> EntitySpec:
    """Make an entity known by name. A second entity of the same name is an error."""
    if spec.name in _entities:
        raise RuntimeError(f"entity {spec.name!r} is already registered")
    _entities[spec.name] = spec
    return spec


def get_entity(name: str) -> EntitySpec:
    key = name.strip().lower()
    if key not in _entities:
        raise RequestError(f"Unknown entity {name!r}; registered: {sorted(_entities)}")
    return _entities[key]


def all_entities() -> dict[str, EntitySpec]:
    return dict(_entities)


@dataclass(frozen=True)
class ActionSpec:
    """One bulk action on one account.

    The target set is either ``filter`` (``{}`` is everything in the account) or ``ids``: a list,
    or a DataFrame with the entity key and a ``pos`` column giving the request order.
    ``params`` belong to the action: ``updates``, ``hard``, ``suffix``, ``status``.
    """

    action: str
    account: Any
    filter: Mapping[str, Any] | None = None
    ids: Any = None
    dedup_by: str | None = None
    batch_size: int | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    action_id: str = "action"
    rate_limit_per_minute: int = DEFAULT_RATE_LIMIT_PER_MINUTE
    report_ids: bool = False

    def payload_json(self) -> str:
        """The request as JSON, for the control table. Ids given as a table are not inlined."""
        body: dict[str, Any] = dict(self.params)
        if self.filter is not None:
            body["filter"] = dict(self.filter)
        if isinstance(self.ids, (list, tuple)):
            body["entity_ids"] = list(self.ids)
        if self.dedup_by:
            body["deduplicate_by"] = self.dedup_by
        return json.dumps(body, default=str)


CONTACT = register_entity(EntitySpec(
    name="contact",
    label="Contacts",
    fields={
        "name": FieldRule(min_length=1, max_length=255, description="Full name.",
                          sample="{given} {last}"),
        "email": FieldRule(min_length=3, max_length=320, pattern=EMAIL_PATTERN,
                           description="Mail address; identifies duplicates.",
                           sample="{given:lower}.{row}@{domain}"),
        "age": FieldRule("int", nullable=True, minimum=0, maximum=150),
        "status": FieldRule(min_length=1, max_length=50, sample="{status}"),
    },
    dedup_fields=("email",),
))

COMPANY = register_entity(EntitySpec(
    name="company",
    label="Companies",
    fields={
        "name": FieldRule(min_length=1, max_length=255, description="Registered name.",
                          sample="{given} {last}"),
        "domain": FieldRule(nullable=True, min_length=3, max_length=255,
                            description="Web domain; identifies duplicates.",
                            sample="company-{row}.{suffix}"),
        "industry": FieldRule(nullable=True, min_length=1, max_length=100, sample="{industry}"),
        "employee_count": FieldRule("int", nullable=True, minimum=0, maximum=10_000_000),
        "status": FieldRule(min_length=1, max_length=50, sample="{status}"),
    },
    dedup_fields=("domain",),
))
