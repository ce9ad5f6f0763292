"""Ordered first-match access rules compiled to one CASE expression."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages that tell of a lost connection.
LOST = ("connection refused", "connection reset", "broken pipe", "no such host", "network is unreachable", "client not connected")
LEVELS = ("ALLOW", "INTERNAL", "EXTERNAL", "REJECT")


class Rule(NamedTuple):
    type: str
    id: str
    method: str
    access: str


def matches(column: Column, pattern: str) -> Column:
    """A literal matches itself, `/re/` the whole value, an empty pattern everything."""
    if not pattern:
        return F.lit(True)
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return column.rlike(rf"^(?:{pattern[1:-1]})\z")
    return column == pattern


def check(rules: list[Rule]) -> None:
    """ValueError for a rule without type, with a bad level or a bad pattern."""
    for n, r in enumerate(rules):
        if not r.type:
            raise ValueError(f"rule {n}: type is missing")
        if r.access not in LEVELS:
            raise ValueError(f"rule {n}: unknown access {r.access!r}")
        for p in (r.type, r.id, r.method):
            if len(p) > 1 and p[0] == p[-1] == "/":
                try:
                    re.compile(p[1:-1])
                except re.error as e:
                    raise ValueError(f"rule {n}: {e}") from e


def decide(rules: list[Rule], type_: Column, id_: Column, method: Column, default: str = "REJECT") -> Column:
    """The access level of the first rule that matches."""
    check(rules)
    out = None
    for r in rules:
        hit = matches(type_, r.type) & matches(id_, r.id) & matches(method, r.method)
        out = F.when(hit, r.access) if out is None else out.when(hit, r.access)
    return F.lit(default) if out is None else out.otherwise(default)


class LifecycleRule(NamedTuple):
    type: str
    id: str
    operation: str  # CREATE, DELETE or ALL
    access: str


def decide_lifecycle(rules: list[LifecycleRule], operation: str, type_: Column, id_: Column) -> Column:
    """The access level of the first rule for the operation that matches; by default all may create and nodes may delete."""
    mine = [Rule(r.type, r.id, "", r.access) for r in rules if r.operation in (operation, "ALL")]
    return decide(mine, type_, id_, F.lit(""), default="ALLOW" if operation == "CREATE" else "INTERNAL")


def client_may(access: Column) -> Column:
    return access.isin("ALLOW", "EXTERNAL")


def node_may(access: Column) -> Column:
    return access.isin("ALLOW", "INTERNAL")


def error_kind(message: Column) -> Column:
    """timeout, connection_error or other: whole messages first, then parts of them, in this order."""
    out = F.when(message.isin("context deadline exceeded", "context canceled"), "timeout")
    for part in LOST:
        out = out.when(message.contains(part), "connection_error")
    return out.when(message.contains("deadline exceeded"), "timeout").otherwise("other")


def first_missing(**fields: Column) -> Column:
    """The name of the first field that is null or empty; null if none is."""
    out = None
    for name, value in fields.items():
        hit = F.coalesce(value, F.lit("")) == ""
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
