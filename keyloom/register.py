"""Where queries and their SQL are registered, and SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FNV = """list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, strlen(object_id)::bigint + 1),
    lambda i: ('0x' || substr(hex(encode(object_id)), (2*i-1)::int, 2))::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"""
FIXED = r"try_cast(nullif(regexp_extract(object_id, '^shard#([+-]?[0-9]+)/', 1), '') AS bigint)"
SHARD = f"CASE WHEN {FIXED} BETWEEN 0 AND 8191 THEN {FIXED} ELSE {FNV} % 8192 END"
PARSED = rf"""CASE WHEN object_id = '' THEN 'empty id' WHEN object_id LIKE 'shard#%' AND instr(object_id, '/') = 0 THEN 'shard id without slash'
    WHEN object_id LIKE 'shard#%' AND {FIXED} IS NULL THEN 'bad shard number' WHEN object_id NOT LIKE 'shard#%' AND instr(object_id, '/') = 1 THEN 'empty node' END"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
