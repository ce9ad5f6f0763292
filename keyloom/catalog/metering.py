"""Registered queries of metrics: counters, gauges, histograms, ratios, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import metrics
from ..register import query
from ..sources import bindings as b
from ..sources.bindings import with_views

_CHANGES = "changes AS (SELECT shard, mod_revision, ts_us, current_node AS to_node, coalesce(lag(current_node) OVER (PARTITION BY shard ORDER BY mod_revision), '') AS from_node, op FROM shard_events)"


def _changes(spark, sf_dir):
    before = F.lag("current_node").over(Window.partitionBy("shard").orderBy("mod_revision"))
    return b.shard_events(spark, sf_dir).select("shard", "mod_revision", "ts_us", F.col("current_node").alias("to_node"), F.coalesce(before, F.lit("")).alias("from_node"), "op")


@query(with_views("shard_events") + f""", {_CHANGES}, m AS (SELECT 'claims' AS metric, to_node AS label FROM changes WHERE op = 'PUT' AND to_node <> from_node UNION ALL SELECT 'releases', from_node FROM changes WHERE from_node <> '' AND (op = 'DELETE' OR to_node <> from_node)
  UNION ALL SELECT 'migrations', from_node || '->' || to_node FROM changes WHERE op = 'PUT' AND from_node <> '' AND to_node <> from_node UNION ALL SELECT 'watch', op FROM changes) SELECT metric, label, count(*) AS total FROM m GROUP BY ALL""")
def a12_shard_counters(spark, sf_dir):
    """Counters of claims, releases, migrations (both nodes known and different) and events, in long form."""
    c = _changes(spark, sf_dir)
    moved = F.col("to_node") != F.col("from_node")
    put, known = F.col("op") == "PUT", F.col("from_node") != ""
    marks = F.array(
        F.when(put & moved, F.struct(F.lit("claims").alias("metric"), F.col("to_node").alias("label"))),
        F.when(known & (~put | moved), F.struct(F.lit("releases").alias("metric"), F.col("from_node").alias("label"))),
        F.when(put & known & moved, F.struct(F.lit("migrations").alias("metric"), F.concat("from_node", F.lit("->"), "to_node").alias("label"))),
        F.struct(F.lit("watch").alias("metric"), F.col("op").alias("label")),
    )
    return c.select(F.explode(F.array_compact(marks)).alias("m")).groupBy("m.metric", "m.label").agg(F.count("*").alias("total"))


@query(with_views("links", "gates") + """, p AS (SELECT source AS gate, target AS node, alive IS TRUE AND seq % 10 <> 0 AS ok FROM links LEFT JOIN gates ON address = source)
  SELECT gate, node, count(*) FILTER (ok) AS pushed, count(*) FILTER (NOT ok) AS dropped FROM p GROUP BY ALL""")
def a12_push_counters(spark, sf_dir):
    """Messages pushed and dropped by node and gate: dead gates drop all, full buffers every tenth."""
    alive = F.broadcast(b.gates(spark).where("alive").select(F.col("address").alias("source"), F.lit(True).alias("_a")))  # a handful of rows
    p = b.links(spark, sf_dir).join(alive, "source", "left").withColumn("ok", F.coalesce("_a", F.lit(False)) & (F.col("seq") % 10 != 0))
    return p.groupBy(F.col("source").alias("gate"), F.col("target").alias("node")).agg(F.count_if("ok").alias("pushed"), F.count_if(~F.col("ok")).alias("dropped"))


@query(with_views("shards", "nodes", "links", "calls") + """ SELECT 'shards' AS gauge, current_node AS label, count(*) AS value FROM shards WHERE current_node <> '' GROUP BY 2 UNION ALL SELECT 'migrating', '', count(*) FILTER (target_node <> '' AND current_node <> '' AND target_node <> current_node) FROM shards
  UNION ALL SELECT 'connected gates', target, count(DISTINCT source) FROM links GROUP BY 2 UNION ALL SELECT 'clients', object_type, sum(CASE WHEN method = 'signup' THEN 1 WHEN method = 'error' THEN -1 ELSE 0 END)::bigint FROM calls GROUP BY 2""")
def a13_cluster_gauges(spark, sf_dir):
    """Shards of a node, migrating shards, gates connected to a node, and clients by type (joined less left)."""
    s = b.shards(spark)
    owned = s.where("current_node <> ''").groupBy("current_node").agg(F.count("*")).select(F.lit("shards").alias("gauge"), F.col("current_node").alias("label"), F.col("count(1)").alias("value"))
    moving = s.agg(F.count_if((F.col("target_node") != "") & (F.col("current_node") != "") & (F.col("target_node") != F.col("current_node"))).alias("value")).select(F.lit("migrating").alias("gauge"), F.lit("").alias("label"), "value")
    gates = b.links(spark, sf_dir).groupBy("target").agg(F.countDistinct("source").alias("value")).select(F.lit("connected gates").alias("gauge"), F.col("target").alias("label"), "value")
    step = F.when(F.col("method") == "signup", 1).when(F.col("method") == "error", -1).otherwise(0)
    clients = b.calls(spark, sf_dir).groupBy("object_type").agg(F.sum(step).alias("value")).select(F.lit("clients").alias("gauge"), F.col("object_type").alias("label"), "value")
    return owned.unionByName(moving).unionByName(gates).unionByName(clients)


def _buckets(bounds, seconds):
    return ", ".join(f"count(*) FILTER ({seconds} <= {float(x)!r}::double) AS le_{i}" for i, x in enumerate(bounds))


@query(with_views("calls") + f"SELECT object_type, method, {_buckets(metrics.OPERATION_BUCKETS, '(duration_us / 10000.0::double)')}, count(*) AS n FROM calls GROUP BY ALL")
def a14_operation_histogram(spark, sf_dir):
    return metrics.histogram(b.calls(spark, sf_dir), ["object_type", "method"], F.col("duration_us") / F.lit(1e4), metrics.OPERATION_BUCKETS).drop("total")


@query(with_views("calls") + f"SELECT status, {_buckets(metrics.STOP_BUCKETS, '(duration_us / 1000.0::double)')}, count(*) AS n FROM calls GROUP BY ALL")
def a14_stop_histogram(spark, sf_dir):
    return metrics.histogram(b.calls(spark, sf_dir), ["status"], F.col("duration_us") / F.lit(1e3), metrics.STOP_BUCKETS).drop("total")


_OUTCOME = "CASE WHEN event_type <> 'error' THEN 'success' WHEN event_id % 4 IN (0, 1) THEN 'timeout' ELSE 'error' END"


@query(f"SELECT event_id % 5 AS operation, {_OUTCOME} AS outcome, count(*) AS n, count(*) FILTER ({_OUTCOME} = 'timeout') AS timeouts FROM events GROUP BY ALL")
def a15_operation_outcomes(spark, sf_dir):
    """Operations by outcome; timeouts are told by their error (z1) and counted once more."""
    message = F.expr("element_at(array('context deadline exceeded', 'rpc: deadline exceeded', 'connection reset', 'no rights'), cast(event_id % 4 as int) + 1)")
    late = policy.error_kind(message) == "timeout"
    outcome = F.when(F.col("event_type") != "error", "success").when(late, "timeout").otherwise("error")
    e = b.table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("operation"), outcome.alias("outcome"))
    return e.groupBy("operation", "outcome").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"))


@query(with_views("calls") + "SELECT object_type, method, ts_us // 300000000 AS step, count(*) AS n, round(avg(duration_us::double) / 1000000, 9) AS mean_s FROM calls GROUP BY ALL")
def q3_mean_duration(spark, sf_dir):
    g = b.calls(spark, sf_dir).groupBy("object_type", "method", F.floor(F.col("ts_us") / 300_000_000).alias("step"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("duration_us") / 1_000_000, 9).alias("mean_s"))


@query(with_views("shards") + "SELECT max(n) - min(n) AS imbalance FROM (SELECT current_node, count(*) AS n FROM shards WHERE current_node <> '' GROUP BY 1)")
def q5_imbalance(spark, sf_dir):
    n = b.shards(spark).where("current_node <> ''").groupBy("current_node").agg(F.count("*").alias("n"))
    return n.agg((F.max("n") - F.min("n")).alias("imbalance"))


@query(with_views("shard_events") + f""", {_CHANGES} SELECT from_node, to_node, count(*) AS n, round(count(*) / 86400.0::double / 30, 12) AS per_s FROM changes WHERE op = 'PUT' AND from_node <> '' AND to_node <> from_node GROUP BY ALL ORDER BY n DESC, from_node, to_node LIMIT 5""")
def q6_migration_paths(spark, sf_dir):
    """The five paths with most migrations, and their rate over thirty days."""
    c = _changes(spark, sf_dir).where("op = 'PUT' and from_node <> '' and to_node <> from_node")
    n = c.groupBy("from_node", "to_node").agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(86400.0) / 30, 12).alias("per_s"))
    return n.orderBy(F.desc("n"), "from_node", "to_node").limit(5)


@query(with_views("shard_events") + f""", {_CHANGES}, c AS (SELECT to_node AS node, count(*) AS claims FROM changes WHERE op = 'PUT' AND to_node <> from_node GROUP BY 1), r AS (SELECT from_node AS node, count(*) AS releases FROM changes WHERE from_node <> '' AND (op = 'DELETE' OR to_node <> from_node) GROUP BY 1)
  SELECT node, claims - releases AS churn FROM c JOIN r USING (node)""")
def q7_net_churn(spark, sf_dir):
    """Claims less releases of the nodes that have both."""
    c = _changes(spark, sf_dir)
    moved = F.col("to_node") != F.col("from_node")
    claims = c.where((F.col("op") == "PUT") & moved).groupBy(F.col("to_node").alias("node")).agg(F.count("*").alias("claims"))
    releases = c.where((F.col("from_node") != "") & ((F.col("op") == "DELETE") | moved)).groupBy(F.col("from_node").alias("node")).agg(F.count("*").alias("releases"))
    return claims.join(releases, "node").select("node", (F.col("claims") - F.col("releases")).alias("churn"))


@query(with_views("shards") + "SELECT round(100.0::double * count(*) FILTER (target_node <> current_node AND target_node <> '' AND current_node <> '') / count(*), 6) AS migrating FROM shards")
def q7_percent_migrating(spark, sf_dir):
    moving = (F.col("target_node") != F.col("current_node")) & (F.col("target_node") != "") & (F.col("current_node") != "")
    return b.shards(spark).agg(F.round(F.lit(100.0) * F.count_if(moving) / F.count("*"), 6).alias("migrating"))


@query(with_views("calls") + "SELECT object_type, status, count(*) AS n FROM calls GROUP BY GROUPING SETS ((object_type, status), (object_type), ()) ")
def q1_sums_by_label(spark, sf_dir):
    """Calls by type and status, by type, and in all."""
    return b.calls(spark, sf_dir).groupingSets([[F.col("object_type"), F.col("status")], [F.col("object_type")], []], F.col("object_type"), F.col("status")).agg(F.count("*").alias("n"))


# rule: (per step of an hour) name, label, condition over the step's columns, least number of steps
_ALERTS = [
    ("many calls", "n > 3", 2),
    ("error rate", "errors / n > 0.05", 2),
    ("slow calls", "p95 > 90000", 2),
    ("unbalanced", "most - least > 1", 3),
    ("idle", "n = 1", 2),
    ("no successes", "errors = n", 1),
    ("losing", "errors > n - errors", 1),
]
_STEPS = """steps AS (SELECT object_type, ts_us // 3600000000 AS step, count(*)::double AS n, count(*) FILTER (status = 'failure')::double AS errors, quantile_cont(duration_us::double, 0.95) AS p95, max(c)::double AS most, min(c)::double AS least
  FROM (SELECT *, count(*) OVER (PARTITION BY object_type, ts_us // 3600000000, method) AS c FROM calls) GROUP BY ALL)"""


@query(with_views("calls") + f", {_STEPS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY step) AS i FROM steps) " + " UNION ALL ".join(
    f"SELECT '{name}' AS alert, object_type, min(step) AS first, max(step) AS last, count(*) AS steps FROM (SELECT *, i - row_number() OVER (PARTITION BY object_type ORDER BY step) AS run FROM numbered WHERE {rule.replace('0.05', '0.05::double')}) GROUP BY object_type, run HAVING count(*) >= {least}" for name, rule, least in _ALERTS))
def q8_alert_rules(spark, sf_dir):
    """Alert rules on hourly steps of a type: each fires where its condition holds for enough steps in a row."""
    c = b.calls(spark, sf_dir).withColumn("step", F.floor(F.col("ts_us") / 3_600_000_000))
    by_method = c.groupBy("object_type", "step", "method").agg(F.count("*").alias("c")).groupBy("object_type", "step").agg(F.max("c").cast("double").alias("most"), F.min("c").cast("double").alias("least"))
    steps = c.groupBy("object_type", "step").agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("status") == "failure").cast("double").alias("errors"), F.percentile("duration_us", 0.95).alias("p95")).join(by_method, ["object_type", "step"])
    return metrics.alerts(steps, ["object_type"], "step", _ALERTS)


@query(with_views("calls") + ", g AS (SELECT object_id, ts_us // 86400000000 AS tick, count(*) AS calls FROM calls GROUP BY ALL), l AS (SELECT *, lag(calls) OVER (PARTITION BY object_id ORDER BY tick) AS before FROM g) SELECT object_id, tick, calls FROM l WHERE before IS DISTINCT FROM calls")
def r7_changed_rates(spark, sf_dir):
    """An object's rate at a refresh, only where it is not that of the refresh before."""
    g = b.calls(spark, sf_dir).groupBy("object_id", F.floor(F.col("ts_us") / 86_400_000_000).alias("tick")).agg(F.count("*").alias("calls"))
    before = F.lag("calls").over(Window.partitionBy("object_id").orderBy("tick"))
    return g.withColumn("before", before).where("not (before <=> calls)").select("object_id", "tick", "calls")


@query(with_views("calls") + ", n AS (SELECT max(ts_us) AS now FROM calls) SELECT object_id, count(*) AS samples, count(*) FILTER (ts_us > now - 43200000000) AS recent FROM calls, n WHERE ts_us > now - 86400000000 GROUP BY 1")
def r6_retained_samples(spark, sf_dir):
    """Samples within the retention, and those in the rate's window; keys without samples are dropped."""
    c = b.calls(spark, sf_dir)
    now = c.agg(F.max("ts_us")).first()[0] or 0
    return c.where(F.col("ts_us") > now - 86_400_000_000).groupBy("object_id").agg(F.count("*").alias("samples"), F.count_if(F.col("ts_us") > now - 43_200_000_000).alias("recent"))
