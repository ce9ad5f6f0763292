"""Registered queries of the live graph: nodes, gates, objects, links, and what dashboards show of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import metrics, store
from ..plans import placement
from ..register import SHARD, query
from ..sources import bindings as b
from ..sources.bindings import with_views


@query(with_views("gates") + ", c AS (SELECT * FROM gates WHERE configured), a AS (SELECT * FROM gates WHERE alive) SELECT coalesce(c.address, a.address) AS address, c.address IS NOT NULL AS configured, a.address IS NOT NULL AS alive FROM c FULL JOIN a ON a.address = c.address")
def j3_gates_full_outer(spark, sf_dir):
    c = b.gates(spark).where("configured").select("address", F.lit(True).alias("configured"))
    a = b.gates(spark).where("alive").select("address", F.lit(True).alias("alive"))
    return c.join(a, "address", "full").select("address", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("configured", "alive")])


@query(with_views("objects", "shards") + f", o AS (SELECT object_id, current_node AS node FROM objects JOIN shards ON shard_id = {SHARD}) SELECT 'object' AS kind, object_id AS id, 1 AS step FROM o WHERE node = 'node-2' UNION ALL SELECT 'node', 'node-2', 2")
def j7_cascade_delete(spark, sf_dir):
    """Events of a node's removal: its objects first, then the node."""
    o = b.objects(spark, sf_dir).select("object_id", ids.shard_id(F.col("object_id")).alias("shard_id"))
    gone = o.join(F.broadcast(b.shards(spark).where("current_node = 'node-2'")), "shard_id")  # 8,192 rows at most
    return gone.select(F.lit("object").alias("kind"), F.col("object_id").alias("id"), F.lit(1).alias("step")).union(spark.range(1).select(F.lit("node"), F.lit("node-2"), F.lit(2)))


@query(with_views("links") + "SELECT seq, count(*) OVER (PARTITION BY source, target ORDER BY ts_us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS calls FROM links")
def w2_link_rates(spark, sf_dir):
    """Calls of the last minute at every call of a link."""
    rows = b.links(spark, sf_dir).withColumn("link", F.concat("source", F.lit("->"), "target"))
    return metrics.rolling(rows, "link", "ts_us", "seq").select("seq", "calls")


@query(with_views("links", "gates", "nodes") + """, t AS (SELECT max(ts_us) AS now FROM links), k AS (SELECT l.* FROM links l SEMI JOIN gates g ON g.address = l.source SEMI JOIN nodes n ON n.address = l.target),
  r AS (SELECT source, target, count(*) FILTER (ts_us > now - 3600000000) AS n FROM k, t GROUP BY ALL) SELECT source, string_agg(target || '=' || n, ',' ORDER BY target) AS rates, sum(n)::bigint AS total FROM r WHERE n > 0 GROUP BY 1""")
def j9_link_metrics(spark, sf_dir):
    """Per known source its known targets with their calls of the last hour, as one sorted list; links without calls are left out."""
    rows = b.links(spark, sf_dir)
    known = rows.join(F.broadcast(b.gates(spark).select(F.col("address").alias("source"))), "source", "left_semi")  # a handful of rows
    known = known.join(F.broadcast(b.nodes(spark).select(F.col("address").alias("target"))), "target", "left_semi")  # a handful of rows
    now = rows.agg(F.max("ts_us")).first()[0] or 0
    n = known.groupBy("source", "target").agg(F.count_if(F.col("ts_us") > now - 3_600_000_000).alias("n")).where("n > 0")
    one = F.concat("target", F.lit("="), "n")
    return n.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("rates"), F.sum("n").alias("total"))


@query(with_views("links", "gates", "nodes") + "SELECT count(*) FILTER (source IN (SELECT address FROM gates WHERE configured) AND target IN (SELECT address FROM nodes WHERE configured)) AS taken, count(*) AS reported FROM links")
def c14_registered_only(spark, sf_dir):
    """Reports whose source and target are both registered, of all."""
    rows = b.links(spark, sf_dir)
    g = F.broadcast(b.gates(spark).where("configured").select(F.col("address").alias("source"), F.lit(True).alias("_g")))  # a handful of rows
    n = F.broadcast(b.nodes(spark).where("configured").select(F.col("address").alias("target"), F.lit(True).alias("_n")))  # a handful of rows
    j = rows.join(g, "source", "left").join(n, "target", "left")
    return j.agg(F.count_if(F.col("_g") & F.col("_n")).alias("taken"), F.count("*").alias("reported"))


@query(with_views("id_samples") + f"SELECT {SHARD} AS shard, count(*) AS objects FROM id_samples WHERE object_id NOT LIKE '%/%' GROUP BY 1")
def a3_local_objects_per_shard(spark, sf_dir):
    """Objects per shard without those whose id names a shard or node."""
    o = b.id_samples(spark, sf_dir).where(~F.col("object_id").contains("/"))
    return o.groupBy(ids.shard_id(F.col("object_id")).alias("shard")).agg(F.count("*").alias("objects"))


_PLACED = f"placed AS (SELECT object_id, object_type, shard_id, current_node FROM objects JOIN shards ON shard_id = {SHARD})"


def _placed(spark, sf_dir):
    o = b.objects(spark, sf_dir).select("object_id", "object_type", ids.shard_id(F.col("object_id")).alias("shard_id"))
    return o.join(F.broadcast(b.shards(spark)), "shard_id")  # 8,192 rows


@query(with_views("objects", "shards") + f", {_PLACED} SELECT *, row_number() OVER (PARTITION BY current_node ORDER BY n DESC, object_type) AS place FROM (SELECT current_node, object_type, count(*) AS n FROM placed GROUP BY ALL)")
def a7_types_per_node(spark, sf_dir):
    n = _placed(spark, sf_dir).groupBy("current_node", "object_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("current_node").orderBy(F.desc("n"), "object_type")).cast("long"))


@query(with_views("objects", "shards", "nodes", "gates") + f", {_PLACED} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM gates) AS gates, count(*) AS objects, count(DISTINCT shard_id) AS active_shards FROM placed")
def a8_cluster_totals(spark, sf_dir):
    totals = _placed(spark, sf_dir).agg(F.count("*").alias("objects"), F.countDistinct("shard_id").alias("active_shards"))
    return totals.select(F.lit(b.nodes(spark).count()).cast("long").alias("nodes"), F.lit(b.gates(spark).count()).cast("long").alias("gates"), "objects", "active_shards")


@query(with_views("objects", "shards") + f""", {_PLACED}, c AS (SELECT s.shard_id, count(p.object_id) AS n FROM shards s LEFT JOIN placed p USING (shard_id) GROUP BY 1), m AS (SELECT greatest(max(n), 1) AS most FROM c)
  SELECT shard_id, n, most, round(CASE WHEN most > 0 THEN 0.85::double + 0.55::double * sqrt(n::double) / sqrt(most::double) ELSE 1 END, 6) AS scale, row_number() OVER (ORDER BY n DESC, shard_id) AS place FROM c, m""")
def o3_shards_by_objects(spark, sf_dir):
    """Shards by number of objects, the fullest first, with the scale of their badges (a10: the largest number, at least 1)."""
    n = _placed(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("n"))
    c = b.shards(spark).select("shard_id").join(n, "shard_id", "left").select("shard_id", F.coalesce("n", F.lit(0)).alias("n"))
    most = F.greatest(F.max("n").over(Window.partitionBy()), F.lit(1))  # 8,192 rows
    place = F.row_number().over(Window.orderBy(F.desc("n"), "shard_id")).cast("long")
    return c.select("shard_id", "n", most.alias("most"), F.round(ids.badge_scale(F.col("n").cast("double"), most.cast("double")), 6).alias("scale"), place.alias("place"))


@query(with_views("objects", "shards") + f", {_PLACED} SELECT shard_id, string_agg(object_id, ',' ORDER BY object_type, object_id) FILTER (r <= 2) AS shown, greatest(count(*) - 2, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY object_type, object_id) AS r FROM placed) GROUP BY 1")
def o5_first_and_more(spark, sf_dir):
    """The first two objects of a shard by type and id, and how many more there are."""
    r = F.row_number().over(Window.partitionBy("shard_id").orderBy("object_type", "object_id"))
    rows = _placed(spark, sf_dir).withColumn("r", r)
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 2, F.struct("r", "object_id")))), lambda x: x["object_id"])
    return rows.groupBy("shard_id").agg(F.array_join(shown, ",").alias("shown"), F.greatest(F.count("*") - 2, F.lit(0)).alias("more"))


@query(with_views("shards") + "SELECT shard_id, row_number() OVER (ORDER BY shard_id) - 1 AS place FROM shards WHERE current_node = '' ORDER BY shard_id")
def o8_unclaimed_shards(spark, sf_dir):
    return placement.ranked(b.shards(spark).where("current_node = ''").select("shard_id"), "shard_id", "place").orderBy("shard_id")


@query(with_views("shard_events") + """, s AS (SELECT shard, mod_revision AS revision, 'node-' || (mod_revision % 3) AS target_node, current_node FROM shard_events), l AS (SELECT *, lag(target_node) OVER w AS t0, lag(current_node) OVER w AS c0, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY shard ORDER BY revision))
  SELECT shard, revision, current_node AS node FROM l WHERE t0 <> '' AND (n > 2 OR t0 <> c0) AND current_node = t0 AND target_node = t0""")
def j11_completed_moves(spark, sf_dir):
    snapshots = b.shard_events(spark, sf_dir).select("shard", F.col("mod_revision").alias("revision"), F.concat(F.lit("node-"), F.col("mod_revision") % 3).alias("target_node"), "current_node")
    return placement.completed_moves(snapshots)


@query(with_views("links") + ", want AS (SELECT DISTINCT source, target FROM links WHERE target <> 'node-3'), have AS (SELECT DISTINCT source, target FROM links WHERE target <> 'node-1') SELECT source, target, 'add' AS change FROM want ANTI JOIN have USING (source, target) UNION ALL SELECT source, target, 'remove' FROM have ANTI JOIN want USING (source, target)")
def u1_connection_changes(spark, sf_dir):
    """What to connect and what to disconnect so that the connections there are become those wanted."""
    rows = b.links(spark, sf_dir).select("source", "target")
    want, have = rows.where("target <> 'node-3'").distinct(), rows.where("target <> 'node-1'").distinct()
    add, gone = want.join(have, ["source", "target"], "left_anti"), have.join(want, ["source", "target"], "left_anti")
    return add.withColumn("change", F.lit("add")).unionByName(gone.withColumn("change", F.lit("remove")))


@query(with_views("links", "gates") + ", have AS (SELECT source AS gate, max(ts_us) AS seen FROM links GROUP BY 1), now AS (SELECT max(ts_us) AS t FROM links) SELECT address AS gate, CASE WHEN NOT alive THEN 'cancel' WHEN seen IS NULL THEN 'register' WHEN seen < t - 60000000 THEN 'register again' ELSE 'keep' END AS change FROM gates LEFT JOIN have ON gate = address, now")
def z7_gate_streams(spark, sf_dir):
    """Streams of gates: undesired ones are cancelled, missing and silent ones registered."""
    rows = b.links(spark, sf_dir)
    have = rows.groupBy(F.col("source").alias("address")).agg(F.max("ts_us").alias("seen"))
    now = rows.agg(F.max("ts_us")).first()[0] or 0
    change = F.when(~F.col("alive"), "cancel").when(F.col("seen").isNull(), "register").when(F.col("seen") < now - 60_000_000, "register again").otherwise("keep")
    return b.gates(spark).join(have, "address", "left").select(F.col("address").alias("gate"), change.alias("change"))


@query(with_views("objects", "shards", "nodes") + f", {_PLACED} SELECT address AS node, object_id FROM nodes LEFT JOIN placed ON current_node = address AND object_type = 'BUILDING'")
def z8_node_report(spark, sf_dir):
    """The report of each node, a row for each of its objects of one type; a node without any reports one row without an object."""
    o = _placed(spark, sf_dir).where("object_type = 'BUILDING'").select(F.col("current_node").alias("address"), "object_id")
    return b.nodes(spark).join(o, "address", "left").select(F.col("address").alias("node"), "object_id")


@query(with_views("links", "nodes", "gates") + ", u AS (SELECT seq, CASE seq % 3 WHEN 0 THEN source WHEN 1 THEN target ELSE 'stranger' END AS peer FROM links) SELECT seq, CASE WHEN peer IN (SELECT address FROM nodes) THEN 'node' WHEN peer IN (SELECT address FROM gates) THEN 'gate' ELSE 'ignored' END AS goes_to FROM u")
def z11_connection_updates(spark, sf_dir):
    """An update of connections goes to the node of its name, else to the gate, else nowhere."""
    peer = F.when(F.col("seq") % 3 == 0, F.col("source")).when(F.col("seq") % 3 == 1, F.col("target")).otherwise("stranger")
    u = b.links(spark, sf_dir).select("seq", peer.alias("address"))
    n = F.broadcast(b.nodes(spark).select("address", F.lit("node").alias("_n")))  # a handful of rows
    g = F.broadcast(b.gates(spark).select("address", F.lit("gate").alias("_g")))  # a handful of rows
    return u.join(n, "address", "left").join(g, "address", "left").select("seq", F.coalesce("_n", "_g", F.lit("ignored")).alias("goes_to"))


@query(with_views("calls") + "SELECT object_id, count(*) AS calls, round(least(2.0::double + count(*) / 10.0::double, 10.0::double), 6) AS width FROM calls GROUP BY 1")
def p20_link_width(spark, sf_dir):
    return b.calls(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("calls")).withColumn("width", F.round(ids.link_width(2.0, F.col("calls")), 6))


@query(with_views("shards") + ", n AS (SELECT target_node AS address, count(*) AS n FROM shards WHERE shard_id % 5 <> 0 OR target_node <> 'node-2' GROUP BY 1) SELECT arg_min(address, (-n, address)) AS fullest, arg_min(address, (n, address)) AS emptiest FROM n")
def o7_fullest_and_emptiest(spark, sf_dir):
    """The nodes with most and fewest shards; of equal ones the first by name."""
    n = b.shards(spark).where("shard_id % 5 <> 0 or target_node <> 'node-2'").groupBy(F.col("target_node").alias("address")).agg(F.count("*").alias("n"))
    return n.agg(F.min_by("address", F.struct(-F.col("n"), F.col("address"))).alias("fullest"), F.min_by("address", F.struct("n", "address")).alias("emptiest"))


@query(with_views("calls") + "SELECT object_type, string_agg(method, ',' ORDER BY method) AS methods, arg_max(method, (n, method)) AS most FROM (SELECT object_type, method, count(*) AS n FROM calls GROUP BY ALL) GROUP BY 1")
def k13_methods_of_types(spark, sf_dir):
    """A type's calls by method as a map: its sorted keys, and the key of its largest value."""
    n = b.calls(spark, sf_dir).groupBy("object_type", "method").agg(F.count("*").alias("n"))  # a few methods
    m = n.groupBy("object_type").agg(F.map_from_entries(F.collect_list(F.struct("method", "n"))).alias("m"))
    largest = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], e["key"].alias("method"))))
    return m.select("object_type", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("methods"), largest["method"].alias("most"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'gate-' ELSE 'node-' END || (user_id % 40) AS address, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op FROM events)
  SELECT address, last_event FROM (SELECT address, max(event_id) AS last_event, arg_max(op, event_id) AS op FROM e GROUP BY 1) WHERE op = 'PUT'""")
def r12_members(spark, sf_dir):
    """Nodes and gates that are there after a log of puts and deletes, which are trusted in order of arrival."""
    i = F.col("event_id")
    e = b.table(spark, sf_dir, "events").select(F.concat(F.when(i % 3 == 0, "gate-").otherwise("node-"), F.col("user_id") % 40).alias("address"), i.alias("last_event"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"))
    return store.latest_state(e, "address", "last_event").select("address", "last_event")


@query(with_views("shard_events") + """, e AS (SELECT shard, mod_revision, current_node FROM shard_events WHERE mod_revision % 9 = 0) SELECT arg_max(current_node, mod_revision) AS leader, max(mod_revision) AS revision FROM e""")
def r12_leader(spark, sf_dir):
    """The leader is the value of the highest revision, whatever the order of arrival."""
    e = b.shard_events(spark, sf_dir).where("mod_revision % 9 = 0")
    return e.agg(F.max_by("current_node", "mod_revision").alias("leader"), F.max("mod_revision").alias("revision"))
