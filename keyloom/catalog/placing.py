"""Registered queries of placement: stuck shards, priorities, pins, auto-loaded objects, stability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import placement
from ..register import SHARD, query
from ..sources import bindings as b
from ..sources.bindings import with_views

_STATES = "states AS (SELECT shard, ts_us, 'node-' || (mod_revision % 5) AS target_node, CASE WHEN mod_revision % 4 = 0 THEN current_node ELSE '' END AS current_node, mod_revision % 31 = 0 AS pinned FROM shard_events)"
_HOUR = 3_600_000_000


def _states(spark, sf_dir):
    r = F.col("mod_revision")
    owner = F.when(r % 4 == 0, F.col("current_node")).otherwise("")
    return b.shard_events(spark, sf_dir).select("shard", "ts_us", F.concat(F.lit("node-"), r % 5).alias("target_node"), owner.alias("current_node"), (r % 31 == 0).alias("pinned"))


_STUCK = f"""{_STATES}, o AS (SELECT shard, ts_us, target_node IN (SELECT address FROM nodes WHERE alive) AND current_node = '' AND NOT pinned AS bad, row_number() OVER (PARTITION BY shard ORDER BY ts_us) AS n FROM states),
  f AS (SELECT DISTINCT shard, 0::bigint AS n, 0::bigint AS ts_us, NULL::bigint AS since, false AS fire FROM o UNION ALL
  SELECT o.shard, o.n, o.ts_us, CASE WHEN NOT o.bad OR (f.since IS NOT NULL AND o.ts_us - f.since >= {_HOUR}) THEN NULL ELSE coalesce(f.since, o.ts_us) END, o.bad AND f.since IS NOT NULL AND o.ts_us - f.since >= {_HOUR} FROM f JOIN o ON o.shard = f.shard AND o.n = f.n + 1)"""


@query(with_views("shard_events", "nodes") + f", {_STUCK} SELECT shard, ts_us FROM f WHERE fire")
def r14_stuck_shards(spark, sf_dir):
    """Checks at which a shard has had a live target and no owner for an hour or longer."""
    return placement.stuck(_states(spark, sf_dir), b.nodes(spark).where("alive"), _HOUR)


@query(with_views("shard_events", "nodes") + f", {_STUCK} SELECT target_node AS from_node, count(*) AS reallocated FROM (SELECT shard, ts_us FROM f WHERE fire) JOIN states USING (shard, ts_us) GROUP BY 1")
def a11_reallocated_per_node(spark, sf_dir):
    """Stuck shards lose their target (n5), counted by the node they are taken from."""
    states = _states(spark, sf_dir)
    gone = placement.stuck(states, b.nodes(spark).where("alive"), _HOUR)
    return gone.join(states, ["shard", "ts_us"]).groupBy(F.col("target_node").alias("from_node")).agg(F.count("*").alias("reallocated"))


@query(with_views("shard_events", "nodes") + f""", {_STUCK}, h AS (SELECT ts_us // {_HOUR} AS tick, count(*) FILTER (target_node = 'node-4') // 3 AS reassigned, count(*) FILTER (current_node = 'node-0') AS moved FROM states GROUP BY 1), s AS (SELECT ts_us // {_HOUR} AS tick, count(*) AS n FROM f WHERE fire GROUP BY 1)
  SELECT tick, CASE WHEN reassigned > 0 THEN 'reassign' WHEN tick % 2 = 0 AND coalesce(n, 0) > 0 THEN 'reallocate' WHEN moved > 0 THEN 'rebalance' ELSE 'none' END AS change FROM h LEFT JOIN s USING (tick)""")
def n6_plan_priority(spark, sf_dir):
    """One kind of change a tick; stuck shards are looked at every other tick."""
    states = _states(spark, sf_dir)
    tick = F.floor(F.col("ts_us") / _HOUR).alias("tick")
    h = states.groupBy(tick).agg(F.floor(F.count_if(F.col("target_node") == "node-4") / 3).alias("reassigned"), F.count_if(F.col("current_node") == "node-0").alias("moved"))
    s = placement.stuck(states, b.nodes(spark).where("alive"), _HOUR).groupBy(tick).agg(F.count("*").alias("n"))
    change = placement.choose(F.col("reassigned"), F.col("tick") % 2 == 0, F.coalesce("n", F.lit(0)), F.col("moved"))
    return h.join(s, "tick", "left").select("tick", change.alias("change"))


_REQUESTS = "asked AS (SELECT (event_id * 3 - 5) AS shard, event_id % 2 = 0 AS pin, 'node-' || (event_id % 7) AS to_node FROM events)"


@query(with_views("ownership", "nodes") + f""", {_REQUESTS} SELECT a.shard, CASE WHEN a.shard NOT BETWEEN 0 AND 8191 THEN 'out of range' WHEN o.shard_id IS NULL THEN 'no such shard' WHEN n.address IS NULL THEN 'unknown node' ELSE 'moved' END AS move,
  CASE WHEN o.shard_id IS NOT NULL THEN CASE WHEN a.pin THEN 'pinned' ELSE '' END END AS flags, CASE WHEN n.address IS NOT NULL THEN a.to_node WHEN o.shard_id IS NOT NULL THEN o.target_node END AS target FROM asked a LEFT JOIN ownership o ON o.shard_id = a.shard LEFT JOIN nodes n ON n.address = a.to_node AND o.shard_id IS NOT NULL""")
def n9_moves_and_pins(spark, sf_dir):
    """Manual moves and pins: range, shard and node are checked; a pin is taken off and set anew."""
    e = F.col("event_id")
    asked = b.table(spark, sf_dir, "events").select((e * 3 - 5).alias("shard"), (e % 2 == 0).alias("pin"), F.concat(F.lit("node-"), e % 7).alias("to_node"))
    o = b.ownership(spark).select(F.col("shard_id").alias("shard"), "target_node", F.when(F.col("pinned"), F.array(F.lit("pinned"))).otherwise(F.array().cast("array<string>")).alias("now"), F.lit(True).alias("_s"))
    n = F.broadcast(b.nodes(spark).select(F.col("address").alias("to_node"), F.lit(True).alias("_n")))  # a handful of rows
    j = asked.join(o, "shard", "left").join(n, "to_node", "left")
    move = F.when(~F.col("shard").between(0, ids.SHARDS - 1), "out of range").when(F.col("_s").isNull(), "no such shard").when(F.col("_n").isNull(), "unknown node").otherwise("moved")
    target = F.when(F.col("_s") & F.col("_n"), F.col("to_node")).when(F.col("_s"), F.col("target_node"))
    return j.select("shard", move.alias("move"), F.array_join(ids.with_flag(F.col("now"), "pinned", F.col("pin")), "|").alias("flags"), target.alias("target"))


_CONFIGS = "configs AS (SELECT * FROM (VALUES ('Clock', 'clock', 'one'), ('Monitor', 'mon', 'shard'), ('Agent', 'agent', 'node'), ('Monitor', 'extra', 'one')) t(type, base, per))"
_WISHED = f"""{_CONFIGS}, wished AS (SELECT type, 'shard#' || i || '/' || base AS object_id FROM configs, range(8192) t(i) WHERE per = 'shard' UNION ALL SELECT type, address || '/' || base FROM configs, nodes WHERE per = 'node' UNION ALL SELECT type, base FROM configs WHERE per = 'one')"""


def _wished(spark):
    configs = spark.createDataFrame([("Clock", "clock", "one"), ("Monitor", "mon", "shard"), ("Agent", "agent", "node"), ("Monitor", "extra", "one")], "type string, base string, per string")
    return placement.desired(configs, b.nodes(spark), ids.SHARDS)


@query(with_views("nodes") + f", {_WISHED} SELECT type, object_id FROM wished")
def u2_wished_ids(spark, sf_dir):
    return _wished(spark)


@query(with_views("nodes") + f", {_WISHED} SELECT type, count(*) AS n, min(object_id) AS first, max(object_id) AS last FROM wished GROUP BY 1")
def u3_ids_by_type(spark, sf_dir):
    return _wished(spark).groupBy("type").agg(F.count("*").alias("n"), F.min("object_id").alias("first"), F.max("object_id").alias("last"))


@query(with_views("nodes", "shards") + f", {_WISHED}, h AS (SELECT type, object_id, {SHARD} AS shard FROM wished) SELECT type, object_id FROM h LEFT JOIN shards ON shard_id = shard WHERE CASE WHEN object_id NOT LIKE 'shard#%' AND instr(object_id, '/') > 0 THEN split_part(object_id, '/', 1) ELSE current_node END = 'node-1'")
def n11_auto_load(spark, sf_dir):
    """The wished objects that one node is to load: those of its shards and its own."""
    kind = ids.parse(F.col("object_id"))
    w = _wished(spark).withColumns({"shard_id": ids.shard_id(F.col("object_id")), "named": kind["node"]})
    j = w.join(F.broadcast(b.shards(spark)), "shard_id", "left")  # 8,192 rows
    return j.where(F.coalesce("named", "current_node") == "node-1").select("type", "object_id")


@query(with_views("shard_events") + f""", h AS (SELECT ts_us // {_HOUR} AS step, max(ts_us) AS last FROM shard_events GROUP BY 1), s AS (SELECT step, last, (step + 1) * {_HOUR} - last >= 600000000 AND step % 5 <> 0 AS stable FROM h)
  SELECT step, stable, bool_or(stable) OVER (ORDER BY step) AS ready FROM s""")
def c12_stability(spark, sf_dir):
    """Stable at the end of an hour: no change for ten minutes and a quorum there; ready once stable, for good (z3)."""
    h = b.shard_events(spark, sf_dir).groupBy(F.floor(F.col("ts_us") / _HOUR).alias("step")).agg(F.max("ts_us").alias("last"))
    stable = ((F.col("step") + 1) * _HOUR - F.col("last") >= 600_000_000) & (F.col("step") % 5 != 0)
    s = h.select("step", stable.alias("stable"))
    return s.withColumn("ready", F.bool_or("stable").over(Window.orderBy("step")))  # a row an hour
