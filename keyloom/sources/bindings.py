"""Logical inputs of the object and call operators, bound to the stored tables."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call log: seq, ts_us, object_id, object_type, method, duration_us, status, call_id, node_key, user_id."""
    e = table(spark, sf_dir, "events")
    kind = F.expr("element_at(array('Counter', 'Wallet', 'ChatRoom', 'Player'), cast(user_id % 4 as int) + 1)")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        micros("ts").alias("ts_us"),
        F.concat(F.lit("User-"), "user_id").alias("object_id"),
        kind.alias("object_type"),
        F.col("event_type").alias("method"),
        F.round(F.col("value") * 1000).cast("long").alias("duration_us"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"),
        F.concat(F.lit("User-"), "user_id", F.lit("-"), F.get_json_object("props", "$.k")).alias("call_id"),
        F.col("user_id"),
        F.col("value"),
    )


def shards(spark: SparkSession, n: int = 8192) -> DataFrame:
    """Ownership: shard_id, target_node, current_node ("" if none), pinned, mod_revision."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("shard_id"),
        F.concat(F.lit("node-"), (i % 4)).alias("target_node"),
        F.when(i % 97 == 0, "").otherwise(F.concat(F.lit("node-"), (i * 7) % 5)).alias("current_node"),
        (i % 50 == 0).alias("pinned"),
        i.alias("mod_revision"),
    )


def nodes(spark: SparkSession) -> DataFrame:
    """Nodes: address, configured, alive, leader. node-4 is dead, node-5 not configured."""
    return spark.range(6).select(
        F.concat(F.lit("node-"), "id").alias("address"),
        (F.col("id") != 5).alias("configured"),
        (F.col("id") != 4).alias("alive"),
        (F.col("id") == 0).alias("leader"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects: object_id, object_type, data (JSON)."""
    c = table(spark, sf_dir, "customer")
    data = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")))
    return c.select(F.concat(F.lit("Customer-"), "c_custkey").alias("object_id"), F.col("c_mktsegment").alias("object_type"), data.alias("data"), "c_custkey", "c_acctbal")


def object_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to objects in order of (written_us, write_no)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("Customer-"), "o_custkey").alias("object_id"), micros("o_orderdate").alias("written_us"), F.col("o_orderkey").alias("write_no"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: request_id, status, created_us, processed_us, retry_count."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.expr("CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'success' END").alias("status"), micros("o_orderdate").alias("created_us"), F.col("o_custkey").alias("object_key"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(micros("l_shipdate")).alias("processed_us"), F.count("*").alias("retry_count"))
    return o.join(lines, o.request_id == lines.l_orderkey, "left").drop("l_orderkey")


def wallet_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallet calls in order of seq: deposits and withdrawals in cents."""
    e = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("Wallet-"), "user_id").alias("wallet_id"), F.when(F.col("event_type") == "signup", "deposit").otherwise("withdraw").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("amount"))


def shard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership changes: shard, mod_revision, current_node, op, ts_us."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("shard"), (F.col("event_id") + 1).alias("mod_revision"), F.concat(F.lit("node-"), F.get_json_object("props", "$.k").cast("long") % 4).alias("current_node"), F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT").alias("op"), micros("ts").alias("ts_us"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored calls: seq, ts_us, call_id, object_id, object_type, method, status, result, error. Some rows break the log's rules."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        (F.col("event_id") + 1).alias("seq"),
        micros("ts").alias("ts_us"),
        F.concat(F.lit("User-"), "user_id", F.lit("-"), k).alias("call_id"),
        F.concat(F.lit("User-"), "user_id").alias("object_id"),
        F.expr("element_at(array('Counter', 'Wallet', 'ChatRoom', 'Player'), cast(user_id % 4 as int) + 1)").alias("object_type"),
        F.col("event_type").alias("method"),
        F.expr("element_at(array('pending', 'success', 'failed', 'skipped', 'success', 'lost'), cast(event_id % 6 as int) + 1)").alias("status"),
        F.when((F.col("event_id") % 6).isin(1, 4) & (F.col("event_id") % 11 != 0), F.concat(F.lit("r"), k)).alias("result"),
        F.when((F.col("event_id") % 6).isin(2, 3) & (F.col("event_id") % 13 != 0), F.concat(F.lit("e"), k)).alias("error"),
        F.col("user_id"),
    )


def ownership(spark: SparkSession) -> DataFrame:
    """Ownership with holes: some shards have no row, some no target."""
    s = shards(spark).where("shard_id % 89 <> 0")
    return s.withColumn("target_node", F.when(F.col("shard_id") % 83 == 0, "").otherwise(F.col("target_node")))


def owner_texts(spark: SparkSession) -> DataFrame:
    """Ownership as texts of four shapes: flags anywhere, white space of all kinds, a very long flag, parts missing."""
    i, t, c = F.col("shard_id") % 4, F.col("target_node"), F.col("current_node")
    value = (
        F.when(i == 0, F.concat(F.lit(" "), t, F.lit(", f= pinned ,"), c, F.lit(", f=,extra")))
        .when(i == 1, F.concat(t, F.lit(",f=a" + "z" * 1200 + ",f=b")))
        .when(i == 2, F.concat(F.lit("\u00a0f=p,\t"), t, F.lit("\u3000,"), c))
        .otherwise(F.concat(t, F.lit(",,f=pinned")))
    )
    return shards(spark).select("shard_id", value.alias("value"))


def gates(spark: SparkSession) -> DataFrame:
    """Gates: gate-1 is dead, gate-2 not configured."""
    i = F.col("id")
    return spark.range(3).select(F.concat(F.lit("gate-"), i).alias("address"), (i != 2).alias("configured"), (i != 1).alias("alive"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between gates and nodes: seq, ts_us, source, target."""
    u = F.col("user_id")
    return calls(spark, sf_dir).select("seq", "ts_us", F.concat(F.lit("gate-"), u % 2).alias("source"), F.concat(F.lit("node-"), u % 5).alias("target"))


def table_counts(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(name, n, problem) of tables: a name that is none is invalid, one that is not in TABLES is missing."""
    frames = []
    for name in names:
        problem = "invalid name" if not re.fullmatch(r"[A-Za-z_]\w*", name) else None if name in TABLES else "missing"
        rows = spark.range(1).select(F.lit(None).cast("long").alias("n")) if problem else table(spark, sf_dir, name).agg(F.count("*").alias("n"))
        frames.append(rows.select(F.lit(name).alias("name"), "n", F.lit(problem).cast("string").alias("problem")))
    return functools.reduce(DataFrame.unionByName, frames)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
ID_VECTORS = ["", "q", "room-9", "shard#12/x", "shard#-4/x", "shard#0031/x", "shard#+8/x", "shard#88888/x", "shard#xyz/x", "shard#/y", "shard#77", "shard#8191/", "/left", "h:1/z", "host:8100/thing"]
ID_VECTORS += ["shards#5/a", "shard# 9/a", "shard#1.5/a", "shard#6/a/b", "shard#000000000000000000000042/x", "shard#99999999999999999999/x", "n\u00e4me-\u540d"]


def id_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object ids of all kinds, well-formed and not."""
    p = table(spark, sf_dir, "part")
    fixed = ID_VECTORS
    return p.select(F.explode(F.array(F.col("p_name"), F.concat(F.lit("shard#"), "p_size", F.lit("/"), "p_name"), F.concat(F.lit("node-1/"), "p_name"))).alias("object_id")).union(spark.createDataFrame([(x,) for x in fixed], "object_id string"))


#: The same inputs in SQL, for checking.
VIEWS = {
    "calls": """SELECT event_id + 1 AS seq, epoch_us(ts) AS ts_us, 'User-' || user_id AS object_id,
        ['Counter','Wallet','ChatRoom','Player'][(user_id % 4)::int + 1] AS object_type, event_type AS method,
        round(value * 1000)::bigint AS duration_us, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
        'User-' || user_id || '-' || (props::json->>'k') AS call_id, user_id, value FROM events""",
    "shards": """SELECT i AS shard_id, 'node-' || (i % 4) AS target_node, CASE WHEN i % 97 = 0 THEN '' ELSE 'node-' || ((i * 7) % 5) END AS current_node,
        i % 50 = 0 AS pinned, i AS mod_revision FROM range(8192) t(i)""",
    "nodes": "SELECT 'node-' || i AS address, i <> 5 AS configured, i <> 4 AS alive, i = 0 AS leader FROM range(6) t(i)",
    "objects": """SELECT 'Customer-' || c_custkey AS object_id, c_mktsegment AS object_type, c_custkey, c_acctbal, c_name, c_nationkey FROM customer""",
    "object_writes": """SELECT 'Customer-' || o_custkey AS object_id, epoch_us(o_orderdate) AS written_us, o_orderkey AS write_no, o_orderstatus AS status, o_totalprice AS price FROM orders""",
    "requests": """SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'success' END AS status,
        epoch_us(o_orderdate) AS created_us, o_custkey AS object_key, processed_us, retry_count FROM orders LEFT JOIN
        (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS processed_us, count(*) AS retry_count FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "wallet_ops": """SELECT event_id AS seq, 'Wallet-' || user_id AS wallet_id, CASE WHEN event_type = 'signup' THEN 'deposit' ELSE 'withdraw' END AS kind,
        round(value * 100)::bigint AS amount FROM events WHERE event_type IN ('signup','purchase')""",
    "shard_events": """SELECT user_id AS shard, event_id + 1 AS mod_revision, 'node-' || ((props::json->>'k')::bigint % 4) AS current_node,
        CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, epoch_us(ts) AS ts_us FROM events""",
    "id_samples": """SELECT unnest([p_name, 'shard#' || p_size || '/' || p_name, 'node-1/' || p_name]) AS object_id FROM part UNION ALL
        SELECT unnest([""" + ", ".join("'" + x + "'" for x in ID_VECTORS) + """])""",
    "call_log": """SELECT event_id + 1 AS seq, epoch_us(ts) AS ts_us, 'User-' || user_id || '-' || (props::json->>'k') AS call_id, 'User-' || user_id AS object_id,
        ['Counter','Wallet','ChatRoom','Player'][(user_id % 4)::int + 1] AS object_type, event_type AS method, ['pending','success','failed','skipped','success','lost'][(event_id % 6)::int + 1] AS status,
        CASE WHEN event_id % 6 IN (1, 4) AND event_id % 11 <> 0 THEN 'r' || (props::json->>'k') END AS result, CASE WHEN event_id % 6 IN (2, 3) AND event_id % 13 <> 0 THEN 'e' || (props::json->>'k') END AS error, user_id FROM events""",
    "ownership": """SELECT shard_id, CASE WHEN shard_id % 83 = 0 THEN '' ELSE target_node END AS target_node, current_node, pinned, mod_revision FROM shards_all WHERE shard_id % 89 <> 0""",
    "owner_texts": """SELECT shard_id, CASE shard_id % 4 WHEN 0 THEN ' ' || target_node || ', f= pinned ,' || current_node || ', f=,extra' WHEN 1 THEN target_node || ',f=a' || repeat('z', 1200) || ',f=b' WHEN 2 THEN e'\u00a0f=p,\t' || target_node || e'\u3000,' || current_node ELSE target_node || ',,f=pinned' END AS value FROM shards_all""",
    "gates": "SELECT 'gate-' || i AS address, i <> 2 AS configured, i <> 1 AS alive FROM range(3) t(i)",
    "links": """SELECT seq, ts_us, 'gate-' || (user_id % 2) AS source, 'node-' || (user_id % 5) AS target FROM calls_all""",
}


def with_views(*names: str) -> str:
    """The WITH clause that defines some of the views."""
    texts = [f"{n} AS ({VIEWS[n].replace('FROM shards_all', f'FROM ({VIEWS['shards']})').replace('FROM calls_all', f'FROM ({VIEWS['calls']})')})" for n in names]
    return "WITH RECURSIVE " + ", ".join(texts) + " "
