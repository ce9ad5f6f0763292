"""Registered queries of the object store, the call log, validation and access."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, policy
from ..operators import calls as replay
from ..operators import store
from ..plans import placement
from ..register import PARSED, SHARD, query
from ..sources import bindings as b
from ..sources.bindings import with_views

_WANTED = "wanted AS (SELECT 'Customer-' || (i * 70) AS object_id FROM range(40) t(i) UNION ALL SELECT '')"


def _wanted(spark):
    return spark.range(40).select(F.concat(F.lit("Customer-"), F.col("id") * 70).alias("object_id")).union(spark.createDataFrame([("",)], "object_id string"))


@query(with_views("objects") + f", {_WANTED} SELECT w.object_id, o.object_id IS NOT NULL AS found, o.c_name AS name, coalesce(o.c_custkey % 5, 0) AS next_seq, CASE WHEN w.object_id = '' THEN 'empty key' END AS error FROM wanted w LEFT JOIN objects o USING (object_id)")
def s1_object_lookup(spark, sf_dir):
    rows = b.objects(spark, sf_dir).select("object_id", F.get_json_object("data", "$.name").alias("name"), (F.col("c_custkey") % 5).alias("next_seq"))
    return store.lookup(_wanted(spark), rows, "object_id").select("object_id", "found", "name", F.coalesce("next_seq", F.lit(0)).alias("next_seq"), "error")


@query(with_views("objects") + "SELECT object_id, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS place FROM objects WHERE object_type = 'BUILDING' ORDER BY place")
def s2_objects_by_type(spark, sf_dir):
    """Objects of a type, the newest first; keys grow with time of creation and break ties."""
    o = b.objects(spark, sf_dir).where("object_type = 'BUILDING'").select("object_id", (-F.col("c_custkey")).alias("age"))
    return placement.ranked(o, "age", "place").select("object_id", "place").orderBy("place")


@query(with_views("objects") + f", {_WANTED} SELECT object_id, EXISTS (SELECT 1 FROM objects o WHERE o.object_id = w.object_id) AS there FROM wanted w")
def s3_object_exists(spark, sf_dir):
    return store.lookup(_wanted(spark), b.objects(spark, sf_dir).select("object_id"), "object_id").select("object_id", F.col("found").alias("there"))


_FIRSTS = "firsts AS (SELECT call_id, min(seq) AS seq, arg_min(object_id, seq) AS object_id, arg_min(status, seq) AS status, arg_min(coalesce(result, '~'), seq) AS result, arg_min(coalesce(error, '~'), seq) AS error FROM call_log GROUP BY 1)"


def _firsts(spark, sf_dir):
    log = b.call_log(spark, sf_dir).select("call_id", "seq", "object_id", "status", "result", "error")
    return store.insert_or_get(log, "call_id", "seq").drop("arrivals", "last")


@query(with_views("call_log") + f", {_FIRSTS}, w AS (SELECT 'User-' || i || '-' || (i % 7) AS call_id FROM range(200) t(i) UNION ALL SELECT '') SELECT w.call_id, f.seq, f.status, CASE WHEN w.call_id = '' THEN 'empty key' WHEN f.seq IS NULL THEN 'not found' END AS error FROM w LEFT JOIN firsts f USING (call_id)")
def s5_call_by_id(spark, sf_dir):
    wanted = spark.range(200).select(F.concat(F.lit("User-"), "id", F.lit("-"), F.col("id") % 7).alias("call_id")).union(spark.createDataFrame([("",)], "call_id string"))
    found = store.lookup(wanted, _firsts(spark, sf_dir).drop("error"), "call_id")
    return found.select("call_id", "seq", "status", F.coalesce("error", F.when(~F.col("found"), "not found")).alias("error"))


@query(with_views("call_log") + "SELECT i AS seq, l.call_id, CASE WHEN i <= 0 THEN 'seq must be positive' WHEN l.seq IS NULL THEN 'not found' END AS problem FROM range(-3, 100000, 97) t(i) LEFT JOIN call_log l ON l.seq = i AND i > 0")
def s6_call_by_seq(spark, sf_dir):
    wanted = spark.range(-3, 100000, 97).withColumnRenamed("id", "seq")
    found = store.lookup(wanted, b.call_log(spark, sf_dir).where("seq > 0").select("seq", "call_id"), "seq")
    return found.select("seq", "call_id", F.when(F.col("seq") <= 0, "seq must be positive").when(~F.col("found"), "not found").alias("problem"))


_KEYS = "CASE event_id % 6 WHEN 0 THEN 'nodes/node-' || user_id WHEN 1 THEN 'gates/gate-' || user_id WHEN 2 THEN 'shard/' || event_id WHEN 3 THEN 'shard/x' || user_id WHEN 4 THEN 'leader' ELSE 'other/' || user_id END"


@query(f"""WITH kv AS (SELECT {_KEYS} AS key FROM events) SELECT kind, name, count(*) AS n FROM (SELECT CASE WHEN key LIKE 'nodes/%' THEN 'node' WHEN key LIKE 'gates/%' THEN 'gate' WHEN key LIKE 'shard/%' THEN 'shard' WHEN key = 'leader' THEN 'leader' END AS kind,
  CASE WHEN key <> 'leader' THEN substr(key, instr(key, '/') + 1) ELSE '' END AS name FROM kv) WHERE kind IS NOT NULL AND (kind <> 'shard' OR try_cast(name AS bigint) BETWEEN 0 AND 8191) GROUP BY ALL""")
def s7_prefix_scan(spark, sf_dir):
    """One scan of all keys, told apart by prefix; shard keys without a number in range are left out."""
    key = F.expr(_KEYS)
    kv = b.table(spark, sf_dir, "events").select(key.alias("key"))
    kind = F.when(F.col("key").startswith("nodes/"), "node").when(F.col("key").startswith("gates/"), "gate").when(F.col("key").startswith("shard/"), "shard").when(F.col("key") == "leader", "leader")
    name = F.when(F.col("key") != "leader", F.expr("substring(key, instr(key, '/') + 1)")).otherwise("")
    rows = kv.select(kind.alias("kind"), name.alias("name")).where("kind is not null")
    return rows.where((F.col("kind") != "shard") | F.col("name").try_cast("long").between(0, ids.SHARDS - 1)).groupBy("kind", "name").agg(F.count("*").alias("n"))


@query(with_views("objects", "shards") + f"SELECT object_type, object_id, c_custkey * 1234567 // 1000000 AS created_s FROM objects JOIN shards ON shard_id = {SHARD} WHERE current_node = 'node-1'")
def s10_live_objects(spark, sf_dir):
    """Type, id and second of creation of the objects on one node (s11: the ids alone)."""
    o = b.objects(spark, sf_dir).select("object_type", "object_id", F.floor(F.col("c_custkey") * 1234567 / 1_000_000).alias("created_s"), ids.shard_id(F.col("object_id")).alias("shard_id"))
    mine = F.broadcast(b.shards(spark).where("current_node = 'node-1'").select("shard_id"))  # 8,192 rows at most
    return o.join(mine, "shard_id").select("object_type", "object_id", "created_s")


@query(with_views("calls", "nodes") + "SELECT address, count(DISTINCT object_id) AS objects, coalesce((max(ts_us) - min(ts_us)) // 1000000, 0) AS uptime_s FROM nodes LEFT JOIN calls ON 'node-' || (user_id % 5) = address GROUP BY 1")
def s12_node_status(spark, sf_dir):
    """Objects per node and whole seconds since its first sample."""
    node = F.concat(F.lit("node-"), F.col("user_id") % 5)
    seen = b.calls(spark, sf_dir).groupBy(node.alias("address")).agg(F.countDistinct("object_id").alias("objects"), F.floor((F.max("ts_us") - F.min("ts_us")) / 1_000_000).alias("uptime_s"))
    return b.nodes(spark).select("address").join(seen, "address", "left").select("address", F.coalesce("objects", F.lit(0)).alias("objects"), F.coalesce("uptime_s", F.lit(0)).alias("uptime_s"))


@query(with_views("objects", "shards", "nodes", "gates") + f""", o AS (SELECT object_id, coalesce(current_node, '') AS node FROM objects LEFT JOIN shards ON shard_id = {SHARD})
  SELECT 'node' AS kind, address AS id, '' AS parent, (SELECT count(*) FROM o WHERE node = address) AS objects FROM nodes UNION ALL SELECT 'gate', address, '', 0 FROM gates UNION ALL SELECT 'object', object_id, node, 0 FROM o""")
def s13_graph_snapshot(spark, sf_dir):
    """Nodes with their number of objects, gates, and objects with their node, in one frame."""
    o = b.objects(spark, sf_dir).select("object_id", ids.shard_id(F.col("object_id")).alias("shard_id"))
    o = o.join(F.broadcast(b.shards(spark)), "shard_id", "left").select("object_id", F.coalesce("current_node", F.lit("")).alias("node"))  # 8,192 rows
    n = b.nodes(spark).join(o.groupBy(F.col("node").alias("address")).agg(F.count("*").alias("n")), "address", "left")
    rows = n.select(F.lit("node").alias("kind"), F.col("address").alias("id"), F.lit("").alias("parent"), F.coalesce("n", F.lit(0)).alias("objects"))
    rows = rows.union(b.gates(spark).select(F.lit("gate"), "address", F.lit(""), F.lit(0).cast("long")))
    return rows.union(o.select(F.lit("object"), "object_id", "node", F.lit(0).cast("long")))


@query(with_views("objects") + "SELECT count(*) FILTER (k % 3 <> 0 AND k % 17 <> 0) AS saved, count(*) FILTER (k % 3 = 0) AS skipped, count(*) FILTER (k % 3 <> 0 AND k % 17 = 0) AS errors, count(*) FILTER (k % 3 <> 0 AND k % 17 = 0) = 0 AS ok FROM (SELECT c_custkey AS k FROM objects)")
def m7_snapshot_counts(spark, sf_dir):
    """What a snapshot of all objects saves, skips as not persistent, and fails on; any failure fails the whole."""
    k = F.col("c_custkey")
    o = b.objects(spark, sf_dir).select((k % 3 != 0).alias("persistent"), (k % 17 == 0).alias("broken"))
    errors = F.count_if(F.col("persistent") & F.col("broken"))
    return o.agg(F.count_if(F.col("persistent") & ~F.col("broken")).alias("saved"), F.count_if(~F.col("persistent")).alias("skipped"), errors.alias("errors"), (errors == 0).alias("ok"))


_MESSAGES = "'context deadline exceeded', 'context canceled', 'dial: connection refused', 'read: connection reset by peer', 'write: broken pipe', 'lookup x: no such host', 'rpc: deadline exceeded after 5s', 'store client not connected', 'no rights'"
_ERRORS = f"errors AS (SELECT event_id, [{_MESSAGES}][(event_id % 9)::int + 1] AS message FROM events)"


@query(f"""WITH {_ERRORS} SELECT message, CASE WHEN message IN ('context deadline exceeded', 'context canceled') THEN 'timeout' WHEN regexp_matches(message, 'connection refused|connection reset|broken pipe|no such host|network is unreachable|client not connected') THEN 'connection_error'
  WHEN message LIKE '%deadline exceeded%' THEN 'timeout' ELSE 'other' END AS kind, count(*) AS n FROM errors GROUP BY ALL""")
def m10_error_kinds(spark, sf_dir):
    message = F.expr(f"element_at(array({_MESSAGES}), cast(event_id % 9 as int) + 1)")
    e = b.table(spark, sf_dir, "events").select(message.alias("message"))
    return e.groupBy("message", policy.error_kind(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))


_LIFE = [policy.LifecycleRule("/MACH.*/", "", "CREATE", "REJECT"), policy.LifecycleRule("BUILDING", "/.*7/", "ALL", "EXTERNAL"), policy.LifecycleRule("BUILDING", "", "DELETE", "ALLOW")]
_CREATE = "CASE WHEN regexp_full_match({t}, 'MACH.*') THEN 'REJECT' WHEN {t} = 'BUILDING' AND regexp_full_match({i}, '.*7') THEN 'EXTERNAL' ELSE 'ALLOW' END"
_DELETE = "CASE WHEN {t} = 'BUILDING' AND regexp_full_match({i}, '.*7') THEN 'EXTERNAL' WHEN {t} = 'BUILDING' THEN 'ALLOW' ELSE 'INTERNAL' END"


@query(with_views("objects") + f""", d AS (SELECT object_id, {_CREATE.format(t="object_type", i="object_id")} AS to_create, {_DELETE.format(t="object_type", i="object_id")} AS to_delete FROM objects)
  SELECT object_id, to_create, to_delete, to_create IN ('ALLOW', 'EXTERNAL') AS client_creates, to_create IN ('ALLOW', 'INTERNAL') AS node_creates, to_delete IN ('ALLOW', 'EXTERNAL') AS client_deletes, to_delete IN ('ALLOW', 'INTERNAL') AS node_deletes FROM d""")
def c4_lifecycle_access(spark, sf_dir):
    t, i = F.col("object_type"), F.col("object_id")
    d = b.objects(spark, sf_dir).select("object_id", policy.decide_lifecycle(_LIFE, "CREATE", t, i).alias("to_create"), policy.decide_lifecycle(_LIFE, "DELETE", t, i).alias("to_delete"))
    c, d_ = F.col("to_create"), F.col("to_delete")
    return d.select("object_id", "to_create", "to_delete", policy.client_may(c).alias("client_creates"), policy.node_may(c).alias("node_creates"), policy.client_may(d_).alias("client_deletes"), policy.node_may(d_).alias("node_deletes"))


_ASKED = "asked AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'Customer-' || (o_custkey * 3) END AS object_id, ['BUILDING','MACHINERY','FURNITURE','ROBOT',''][(o_orderkey % 5)::int + 1] AS type FROM orders)"


def _asked(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 50 == 0, "").otherwise(F.concat(F.lit("Customer-"), F.col("o_custkey") * 3))
    kind = F.expr("element_at(array('BUILDING', 'MACHINERY', 'FURNITURE', 'ROBOT', ''), cast(o_orderkey % 5 as int) + 1)")
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), key.alias("object_id"), kind.alias("type"))


@query(with_views("objects") + f""", {_ASKED} SELECT request, CASE WHEN a.object_id = '' THEN 'id must be given' WHEN o.object_type = a.type THEN 'exists' WHEN o.object_id IS NOT NULL THEN 'other type'
  WHEN {_CREATE.format(t="a.type", i="a.object_id")} = 'REJECT' OR {_CREATE.format(t="a.type", i="a.object_id")} = 'EXTERNAL' THEN 'denied' WHEN a.type NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'unknown type' ELSE 'created' END AS decision FROM asked a LEFT JOIN objects o USING (object_id)""")
def m13_create_decisions(spark, sf_dir):
    allowed = policy.node_may(policy.decide_lifecycle(_LIFE, "CREATE", F.col("type"), F.col("object_id")))
    return store.create_decisions(_asked(spark, sf_dir), b.objects(spark, sf_dir), ["BUILDING", "MACHINERY", "FURNITURE"], allowed).select("request", "decision")


@query(with_views("objects") + f""", {_ASKED} SELECT request, CASE WHEN a.type = '' THEN 'type must be given' WHEN o.object_id IS NULL THEN 'nothing to delete' WHEN o.object_type <> a.type THEN 'other type'
  WHEN {_DELETE.format(t="a.type", i="a.object_id")} = 'EXTERNAL' THEN 'denied' ELSE 'deleted' END AS decision FROM asked a LEFT JOIN objects o USING (object_id)""")
def m12_delete_decisions(spark, sf_dir):
    allowed = policy.node_may(policy.decide_lifecycle(_LIFE, "DELETE", F.col("type"), F.col("object_id")))
    return store.delete_decisions(_asked(spark, sf_dir), b.objects(spark, sf_dir), allowed).select("request", "decision")


@query(with_views("objects", "ownership", "nodes") + f""", {_ASKED}, p AS (SELECT request, type, object_id, CASE WHEN object_id = '' THEN type || '-' || request ELSE object_id END AS id FROM asked), q AS (SELECT request, type, id AS object_id FROM p),
  r AS (SELECT request, type, object_id, {PARSED} AS bad, {SHARD} AS shard FROM q)
  SELECT request, object_id, CASE WHEN type = '' THEN 'type must be given' WHEN bad IS NOT NULL THEN bad WHEN o.shard_id IS NULL THEN 'no owner' WHEN o.current_node = '' THEN 'unclaimed' WHEN n.alive IS NOT TRUE THEN 'owner dead' ELSE o.current_node END AS target
  FROM r LEFT JOIN ownership o ON o.shard_id = shard LEFT JOIN nodes n ON n.address = o.current_node""")
def z15_create_target(spark, sf_dir):
    """The node that is to create an object: an id that is not given is made of the type and the request."""
    a = _asked(spark, sf_dir)
    a = a.withColumn("object_id", F.when(F.col("object_id") == "", F.concat("type", F.lit("-"), "request")).otherwise(F.col("object_id")))
    owners = b.ownership(spark).join(b.nodes(spark).select(F.col("address").alias("current_node"), "alive"), "current_node", "left")
    j = a.withColumn("_at", ids.shard_id(F.col("object_id"))).join(F.broadcast(owners), F.col("_at") == F.col("shard_id"), "left")  # 8,192 rows
    bad = ids.parse(F.col("object_id"))["error"]
    target = F.when(F.col("type") == "", "type must be given").when(bad.isNotNull(), bad).when(F.col("shard_id").isNull(), "no owner").when(F.col("current_node") == "", "unclaimed").when(~F.coalesce("alive", F.lit(False)), "owner dead").otherwise(F.col("current_node"))
    return j.select("request", "object_id", target.alias("target"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c' END AS call_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE 't' END AS object_type, CASE WHEN event_id % 11 = 0 THEN '' ELSE 'o' END AS object_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'm' END AS method FROM events)
  SELECT event_id, CASE WHEN call_id = '' OR object_type = '' OR object_id = '' OR method IS NULL THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN call_id = '' THEN 'call_id' WHEN object_type = '' THEN 'object_type' WHEN object_id = '' THEN 'object_id' WHEN method IS NULL THEN 'method' END AS missing FROM c""")
def c13_call_validation(spark, sf_dir):
    """Calls without a needed field are skipped; the first missing field is named."""
    e = F.col("event_id")
    missing = policy.first_missing(call_id=F.when(e % 5 != 0, "c").otherwise(""), object_type=F.when(e % 7 != 0, "t").otherwise(""), object_id=F.when(e % 11 != 0, "o").otherwise(""), method=F.when(e % 13 != 0, "m"))
    return b.table(spark, sf_dir, "events").select("event_id", F.when(missing.isNull(), "pending").otherwise("skipped").alias("status"), missing.alias("missing"))


@query(with_views("call_log") + f""", {_FIRSTS}, c AS (SELECT object_id, max(seq) + 1 AS cursor FROM call_log WHERE seq % 7 = 3 GROUP BY 1)
  SELECT a.seq, CASE WHEN f.status IN ('success', 'failed', 'skipped') THEN f.status WHEN f.status <> 'pending' THEN 'unknown' WHEN f.seq < coalesce(cursor, 0) THEN 'left behind' ELSE 'waits' END AS outcome,
  CASE WHEN f.status = 'success' THEN nullif(f.result, '~') WHEN f.status IN ('failed', 'skipped') THEN nullif(f.error, '~') END AS answer FROM call_log a JOIN firsts f USING (call_id) LEFT JOIN c ON c.object_id = f.object_id""")
def r4_stored_replies(spark, sf_dir):
    """What every arriving call is told: the stored result of the first with its id, to wait, or that it was left behind."""
    log = b.call_log(spark, sf_dir)
    cursors = log.where("seq % 7 = 3").groupBy("object_id").agg((F.max("seq") + 1).alias("cursor"))
    firsts = _firsts(spark, sf_dir).join(cursors, "object_id", "left").withColumn("cursor", F.coalesce("cursor", F.lit(0)))
    return replay.replies(log.select(F.col("seq").alias("arrival"), "call_id"), firsts).select(F.col("arrival").alias("seq"), "outcome", "answer")


@query(with_views("call_log") + ", c AS (SELECT object_id, max(seq) + 1 AS cursor FROM call_log WHERE seq % 7 = 3 GROUP BY 1) SELECT seq, CASE WHEN seq < cursor THEN 'closed' WHEN seq = cursor THEN 'result' ELSE 'waits' END AS waiter, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS place FROM call_log JOIN c USING (object_id)")
def r3_waiters(spark, sf_dir):
    """Waiters by seq against their object's cursor: passed ones are closed, the one at the cursor gets its result."""
    log = b.call_log(spark, sf_dir)
    cursors = log.where("seq % 7 = 3").groupBy("object_id").agg((F.max("seq") + 1).alias("cursor"))
    waiter = F.when(F.col("seq") < F.col("cursor"), "closed").when(F.col("seq") == F.col("cursor"), "result").otherwise("waits")
    place = F.row_number().over(Window.partitionBy("object_id").orderBy("seq")).cast("long")
    return log.join(cursors, "object_id").select("seq", waiter.alias("waiter"), place.alias("place"))


@query(with_views("calls") + ", seeds AS (SELECT 'User-' || lpad(i::varchar, 3, '0') AS object_id FROM range(1, 101) t(i)) SELECT object_id, object_id NOT IN (SELECT object_id FROM calls) AS created FROM seeds")
def z22_seed_objects(spark, sf_dir):
    """A hundred numbered ids and which of them are new."""
    seeds = spark.range(1, 101).select(F.concat(F.lit("User-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("object_id"))
    return store.lookup(seeds, b.calls(spark, sf_dir).select("object_id").distinct(), "object_id").select("object_id", (~F.col("found")).alias("created"))


@query(with_views("requests") + "SELECT object_key, count(*) AS n FROM requests WHERE status = 'pending' AND created_us < (SELECT max(created_us) FROM requests) - 300000000 GROUP BY 1")
def q9_old_pending(spark, sf_dir):
    """Pending requests older than five minutes at the time of the newest."""
    r = b.requests(spark, sf_dir)
    newest = r.agg(F.max("created_us")).first()[0] or 0
    return r.where((F.col("status") == "pending") & (F.col("created_us") < newest - 300_000_000)).groupBy("object_key").agg(F.count("*").alias("n"))


@query(with_views("requests") + "SELECT status, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 2) AS share FROM requests WHERE created_us > (SELECT max(created_us) FROM requests) - 90 * 86400000000 GROUP BY status")
def q11_recent_share(spark, sf_dir):
    """Share of each status among the requests of the last 90 days before the newest."""
    r = b.requests(spark, sf_dir)
    newest = r.agg(F.max("created_us")).first()[0] or 0
    c = r.where(F.col("created_us") > newest - 90 * 86_400_000_000).groupBy("status").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # a row for each status


@query(with_views("call_log") + "SELECT seq, CASE status WHEN 'pending' THEN 1 WHEN 'success' THEN 2 WHEN 'failed' THEN 3 WHEN 'skipped' THEN 4 ELSE 0 END AS code FROM call_log")
def p16_status_codes(spark, sf_dir):
    """Numbers of statuses; an unknown text is 0."""
    codes = F.create_map(*[F.lit(x) for pair in (("pending", 1), ("success", 2), ("failed", 3), ("skipped", 4)) for x in pair])
    return b.call_log(spark, sf_dir).select("seq", F.coalesce(F.try_element_at(codes, "status"), F.lit(0)).alias("code"))


@query(with_views("objects") + "SELECT object_id, c_custkey AS key, c_acctbal AS balance, c_nationkey AS nation, c_nationkey = 0 AS omitted FROM objects")
def p13_json_round_trip(spark, sf_dir):
    """State saved as JSON with 64-bit numbers as text and zeros left out, and read back."""
    o = b.objects(spark, sf_dir).select("object_id", "c_custkey", F.from_json("data", "balance double, nation int").alias("d"))
    saved = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("key"), F.col("d.balance").alias("balance"), F.expr("nullif(d.nation, 0)").alias("nation")))
    read = F.from_json("saved", "key string, balance double, nation int")
    o = o.select("object_id", saved.alias("saved")).withColumn("r", read)
    return o.select("object_id", F.col("r.key").cast("long").alias("key"), F.col("r.balance").alias("balance"), F.coalesce("r.nation", F.lit(0)).alias("nation"), F.get_json_object("saved", "$.nation").isNull().alias("omitted"))


@query("WITH last AS (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id AS room, role AS last_role, turn AS last_turn, n FROM last")
def k15_nested_state(spark, sf_dir):
    """A room's state as nested JSON, and fields taken out of it."""
    c = b.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.count("*").alias("n"))
    state = F.to_json(F.named_struct(F.lit("room"), F.col("conv_id"), F.lit("last"), F.named_struct(F.lit("turn"), F.col("turn"), F.lit("role"), F.col("role")), F.lit("n"), F.col("n")))
    c = c.select(state.alias("s"))
    return c.select(F.get_json_object("s", "$.room").cast("long").alias("room"), F.get_json_object("s", "$.last.role").alias("last_role"), F.get_json_object("s", "$.last.turn").cast("long").alias("last_turn"), F.get_json_object("s", "$.n").cast("long").alias("n"))
