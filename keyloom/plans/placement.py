"""Placement planning over shards and nodes as set computations."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, order: str, out: str, block: int = 1024, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds `out`, the place from 0 of each row by `order` (a whole number) among the rows with equal `keys`.

    Rows are counted by block of numbers first, so no task ranks more than a block and the list of blocks."""
    b = F.floor(F.col(order) / block)
    sums = rows.groupBy(*keys, b.alias("_block")).agg(F.count("*").alias("_n"))
    sums = sums.select(*keys, "_block", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_n")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)) - 1
    return rows.withColumn("_block", b).join(sums, [*keys, "_block"]).withColumn(out, F.col("_base") + inner).drop("_block", "_base")


def assign(shards: DataFrame, alive: DataFrame, offset: int = 0) -> DataFrame:
    """New targets: a pinned or live target stays, a live owner of an untargeted shard becomes its target, and the rest is
    dealt round-robin over the sorted live nodes from `offset`, in order of shard id. Without live nodes there is no plan.

    The number of live nodes is small; shards to deal are ranked by a window over blocks of ids."""
    names = sorted(r.address for r in alive.collect())
    if not names:
        return shards.select("shard_id", F.col("target_node").alias("new_target"), F.lit(False).alias("dealt")).limit(0)
    live = F.col("target_node").isin(names)
    keep = (F.col("pinned") & (F.col("target_node") != "")) | live
    mine = (F.col("target_node") == "") & F.col("current_node").isin(names)
    marked = shards.withColumn("_deal", ~keep & ~mine).withColumn("_block", F.floor(F.col("shard_id") / 1024))
    sums = marked.groupBy("_block").agg(F.count_if("_deal").alias("_n"))
    sums = sums.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_base"))
    inner = F.count_if("_deal").over(Window.partitionBy("_block").orderBy("shard_id")) - 1
    dealt = F.element_at(F.array(*map(F.lit, names)), ((F.col("_base") + inner + offset) % len(names) + 1).cast("int"))
    new = F.when(keep, F.col("target_node")).when(mine, F.col("current_node")).otherwise(dealt)
    return marked.join(sums, "_block").select("shard_id", new.alias("new_target"), F.col("_deal").alias("dealt"))


def rebalance(counts: dict[str, int], free: dict[str, list[int]], shards: int, batch: int, threshold: float = 0.2) -> list[tuple[int, str, str]]:
    """Moves (shard, from, to): from the fullest to the emptiest node while they differ by 2 and by more than `threshold` of
    the mean, at most `batch`; ties go to the first name. A shard moves once. The plan ends when the fullest node has no
    movable shard."""
    load = dict(counts)
    left = {n: sorted(s) for n, s in free.items()}
    moves = []
    while len(moves) < batch and load:
        top, low = min(load, key=lambda n: (-load[n], n)), min(load, key=lambda n: (load[n], n))
        gap = load[top] - load[low]
        if gap < 2 or gap <= threshold * shards / len(load) or not left.get(top):
            break
        moves.append((heapq.heappop(left[top]), top, low))
        load[top] -= 1
        load[low] += 1
    return moves


def rebalance_plan(shards: DataFrame, alive: DataFrame, batch: int | None = None) -> DataFrame:
    """(shard_id, from_node, to_node). Nothing is moved while any shard lacks a target.

    The driver gets one count for each node and, of each node, the `batch` lowest shards that may move."""
    n = shards.agg(F.count("*").alias("n"), F.count_if(F.coalesce("target_node", F.lit("")) == "").alias("open")).first()
    schema = "shard_id long, from_node string, to_node string"
    spark = shards.sparkSession
    if n.open or not n.n:
        return spark.createDataFrame([], schema)
    batch = batch or max(1, n.n // 128)
    counts = {r.address: 0 for r in alive.collect()}
    for r in shards.groupBy("target_node").count().collect():  # a row for each node
        if r.target_node in counts:
            counts[r.target_node] = r["count"]
    lowest = shards.where(~F.col("pinned")).withColumn("_r", F.row_number().over(Window.partitionBy("target_node").orderBy("shard_id"))).where(F.col("_r") <= batch)
    free: dict[str, list[int]] = {}
    for r in lowest.select("shard_id", "target_node").collect():  # at most `batch` for each node
        free.setdefault(r.target_node, []).append(r.shard_id)
    return spark.createDataFrame(rebalance(counts, free, n.n, batch), schema)


def stuck(states: DataFrame, alive: DataFrame, timeout_us: int, key: str = "shard", at: str = "ts_us") -> DataFrame:
    """(key, at) of every check at which a shard is found stuck for `timeout_us` or longer.

    Stuck: a live target, no owner, not pinned. `states` has a row per check and shard; a run of stuck checks starts at its
    first, a check at which the shard is not stuck ends it, and a report starts a new one at the next check."""
    names = F.broadcast(alive.select(F.col("address").alias("target_node"), F.lit(True).alias("_alive")))  # a handful of rows
    is_stuck = (F.col("target_node") != "") & (F.col("current_node") == "") & F.coalesce("_alive", F.lit(False)) & ~F.col("pinned")
    dealt = states.join(names, "target_node", "left").select(key, at, is_stuck.alias("_stuck")).repartition(key).sortWithinPartitions(key, at)

    def fold(batches):
        now, since = None, None
        for b in batches:
            hit = []
            for k, t, s in zip(b[key], b[at], b["_stuck"]):
                if k != now:
                    now, since = k, None
                fire = bool(s) and since is not None and t - since >= timeout_us
                hit.append(fire)
                since = None if fire or not s else t if since is None else since
            yield b.loc[hit, [key, at]]

    kinds = dict(states.dtypes)
    return dealt.mapInPandas(fold, f"{key} {kinds[key]}, {at} {kinds[at]}")


def desired(configs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(type, object_id) of auto-loaded objects: configs (type, base, per) with per `shard`, `node` or `one`."""
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by_shard = configs.where("per = 'shard'").select("type", "base", every.alias("i")).select("type", F.concat(F.lit("shard#"), "i", F.lit("/"), "base").alias("object_id"))
    names = sorted(r.address for r in nodes.collect())  # a handful of rows
    address = F.explode(F.array(*map(F.lit, names)).cast("array<string>"))
    by_node = configs.where("per = 'node'").select("type", "base", address.alias("address")).select("type", F.concat("address", F.lit("/"), "base").alias("object_id"))
    return by_shard.unionByName(by_node).unionByName(configs.where("per = 'one'").select("type", F.col("base").alias("object_id")))


def completed_moves(snapshots: DataFrame, key: str = "shard", at: str = "revision") -> DataFrame:
    """(key, at, node) of snapshots at which target and owner are the target tracked from the snapshot before.

    The first snapshot tracks only shards that are not with their target; every later one tracks all with a target."""
    w = Window.partitionBy(key).orderBy(at)
    before, owner, first = F.lag("target_node").over(w), F.lag("current_node").over(w), F.row_number().over(w) == 2
    rows = snapshots.withColumns({"_before": before, "_owner": owner, "_second": first})
    tracked = (F.col("_before") != "") & (~F.col("_second") | (F.col("_before") != F.col("_owner")))
    return rows.where(tracked & (F.col("current_node") == F.col("_before")) & (F.col("target_node") == F.col("_before"))).select(key, at, F.col("current_node").alias("node"))


def choose(reassigned: Column, stuck_due: Column, stuck_shards: Column, rebalanced: Column) -> Column:
    """The one kind of change of a tick: reassignment, then stuck shards if a check is due, then rebalancing."""
    return F.when(reassigned > 0, "reassign").when(stuck_due & (stuck_shards > 0), "reallocate").when(rebalanced > 0, "rebalance").otherwise("none")
