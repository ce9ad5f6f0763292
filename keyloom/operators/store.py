"""Keyed object store and exactly-once call log as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(writes: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Latest values per key, with the first and last of order[0] as created and updated."""
    at = F.struct(*order)
    picked = [F.max_by(v, at).alias(v) for v in values]
    return writes.groupBy(key).agg(*picked, F.min(order[0]).alias("created"), F.max(order[0]).alias("updated"), F.count("*").alias("writes"))


def insert_or_get(arrivals: DataFrame, key: str, order: str) -> DataFrame:
    """The first arrival per key; `last` is the order number of its last duplicate.

    One aggregate with map-side combining, so a key with very many duplicates sends one row per task."""
    others = [c for c in arrivals.columns if c != key]
    first = F.min_by(F.struct(*others), F.col(order)).alias("f")
    return arrivals.groupBy(key).agg(first, F.count("*").alias("arrivals"), F.max(order).alias("last")).select(key, *[f"f.{c}" for c in others], "arrivals", "last")


def pending(log: DataFrame, cursors: DataFrame, key: str, order: str) -> DataFrame:
    """Pending calls at or after their object's cursor."""
    return log.where("status = 'pending'").join(cursors, key).where(F.col(order) >= F.col("cursor"))


def compare_and_set(state: DataFrame, proposals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new state) of proposals (key, proposal, expected) taken in order of `proposal`, a fresh revision each.

    A proposal is applied if the key's revision is then the expected one; the revision becomes the proposal, so of several
    with one expected revision the first wins and a later one may build on it. Of proposals for one (key, expected) only
    the first after that revision can win, or the first of all where the key's first revision is a higher number; map-side
    minima find them, and one key's winners stream through a fold. A key without state has revision 0. Null keys and null
    numbers are never applied."""
    firsts = proposals.withColumn("_after", F.col("proposal") > F.col("expected")).where(F.col("_after").isNotNull() & F.col(key).isNotNull())
    firsts = firsts.groupBy(key, "expected", "_after").agg(F.min("proposal").alias("proposal"))
    chains = firsts.join(state.select(key, F.col("mod_revision").alias("_first")), key, "left").withColumn("_first", F.coalesce("_first", F.lit(0).cast("long")))
    chains = chains.where(F.col("_after") | (F.col("expected") == F.col("_first"))).drop("_after")
    dealt = chains.repartition(key).sortWithinPartitions(key, "proposal")

    def fold(batches):
        at, revision = None, None
        for b in batches:
            won = []
            for k, expected, proposal, first in zip(b[key], b.expected, b.proposal, b["_first"]):
                if k != at:
                    at, revision = k, first
                won.append(expected == revision)
                if won[-1]:
                    revision = proposal
            yield b.loc[won, [key, "expected", "proposal"]]

    kind = dict(firsts.dtypes)
    applied = dealt.mapInPandas(fold, f"{key} {kind[key]}, expected {kind['expected']}, proposal {kind['proposal']}").withColumn("_won", F.lit(True))
    outcomes = proposals.join(applied, [key, "expected", "proposal"], "left").withColumn("applied", F.coalesce("_won", F.lit(False))).drop("_won")
    last = applied.groupBy(key).agg(F.max("proposal").alias("_new"))
    after = state.join(last, key, "full").select(key, F.coalesce("_new", "mod_revision").alias("mod_revision"))
    return outcomes, after


def lookup(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Every wanted key with the row it names, `found`, and an error for an empty or null key. A missing row is not an error."""
    known = rows.withColumn("_here", F.lit(True))
    joined = wanted.join(known, key, "left").withColumn("found", F.coalesce("_here", F.lit(False))).drop("_here")
    empty = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return joined.withColumn("error", F.when(empty, "empty key"))


def update_status(log: DataFrame, updates: DataFrame, key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(new log, updates that name no row). Status, result and error of the named rows are replaced; any status may follow
    any other. `updates` has at most one row a key."""
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in ("status", "result", "error")], F.lit(True).alias("_hit"))
    joined = log.join(new, key, "left")
    changed = joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("status", "result", "error")})
    return changed.select(log.columns), updates.join(log.select(key), key, "left_anti")


def violations(log: DataFrame) -> DataFrame:
    """Rows that break a rule of the log: a known status, a result with success, an error with failed and skipped."""
    known = F.col("status").isin("pending", "success", "failed", "skipped")
    bad = (
        F.when(~F.coalesce(known, F.lit(False)), "unknown status")
        .when((F.col("status") == "success") & F.col("result").isNull(), "success without result")
        .when(F.col("status").isin("failed", "skipped") & F.col("error").isNull(), "failure without error")
    )
    return log.withColumn("violation", bad).where("violation is not null")


def create_decisions(wanted: DataFrame, existing: DataFrame, types: list[str], allowed) -> DataFrame:
    """Adds `decision` to wanted (object_id, type): the same type again is fine, another type is not, unknown types are not."""
    known = existing.select("object_id", F.col("object_type").alias("_real"))
    decision = (
        F.when(F.coalesce("object_id", F.lit("")) == "", "id must be given")
        .when(F.col("_real") == F.col("type"), "exists")
        .when(F.col("_real").isNotNull(), "other type")
        .when(~allowed, "denied")
        .when(~F.col("type").isin(types), "unknown type")
        .otherwise("created")
    )
    return wanted.join(known, "object_id", "left").withColumn("decision", decision).drop("_real")


def delete_decisions(wanted: DataFrame, existing: DataFrame, allowed) -> DataFrame:
    """Adds `decision` to wanted (object_id, type): a missing object is fine, a wrong type is not, rules come last."""
    known = existing.select("object_id", F.col("object_type").alias("_real"))
    decision = (
        F.when(F.coalesce("type", F.lit("")) == "", "type must be given")
        .when(F.col("_real").isNull(), "nothing to delete")
        .when(F.col("_real") != F.col("type"), "other type")
        .when(~allowed, "denied")
        .otherwise("deleted")
    )
    return wanted.join(known, "object_id", "left").withColumn("decision", decision).drop("_real")


def latest_state(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change per key by revision, without keys whose last change deletes."""
    others = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("l"))
    return last.where("l.op <> 'DELETE'").select(key, *[f"l.{c}" for c in others])
