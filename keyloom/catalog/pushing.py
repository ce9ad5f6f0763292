"""Registered queries of pushes to clients, gateway texts, small state machines and queues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import placement
from ..register import query
from ..sources import bindings as b
from ..sources.bindings import with_views

_PUSHES = "pushes AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN 'no-slash' ELSE 'gate-' || (turn % 4) || '/' || role || turn END AS client FROM conversations)"
_SPLIT = "CASE WHEN instr(client, '/') > 1 AND instr(client, '/') < length(client) THEN split_part(client, '/', 1) END AS gate, CASE WHEN instr(client, '/') > 1 AND instr(client, '/') < length(client) THEN substr(client, instr(client, '/') + 1) END AS uid"


def _pushes(spark, sf_dir):
    """A push for each conversation, with a client id for each turn; some pushes have a malformed one."""
    client = F.when((F.col("conv_id") % 9 == 4) & (F.col("turn") == 1), "no-slash").otherwise(F.concat(F.lit("gate-"), F.col("turn") % 4, F.lit("/"), "role", "turn"))
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", client.alias("client"))


@query(f"WITH {_PUSHES} SELECT client, {_SPLIT}, count(*) AS n FROM pushes GROUP BY ALL")
def p10_client_ids(spark, sf_dir):
    p = ids.client_parts(F.col("client"))
    return _pushes(spark, sf_dir).groupBy("client", p["gate"].alias("gate"), p["unique"].alias("uid")).agg(F.count("*").alias("n"))


@query(with_views("gates") + f""", {_PUSHES}, s AS (SELECT conv_id, client, {_SPLIT} FROM pushes), bad AS (SELECT DISTINCT conv_id FROM s WHERE gate IS NULL),
  g AS (SELECT conv_id, gate, string_agg(client, ',' ORDER BY client) AS clients FROM s ANTI JOIN bad USING (conv_id) GROUP BY ALL)
  SELECT conv_id, gate, clients, CASE WHEN alive IS TRUE THEN 'sent' ELSE 'dropped' END AS outcome FROM g LEFT JOIN gates ON address = gate UNION ALL SELECT conv_id, NULL, NULL, 'aborted' FROM bad""")
def r15_unicast(spark, sf_dir):
    """One envelope a gate with its recipients; a malformed id aborts the push before anything is sent, a gate that is not connected drops it."""
    p = ids.client_parts(F.col("client"))
    rows = _pushes(spark, sf_dir).withColumn("gate", p["gate"])
    bad = rows.where("gate is null").select("conv_id").distinct()
    sent = rows.join(bad, "conv_id", "left_anti").groupBy("conv_id", "gate").agg(F.array_join(F.array_sort(F.collect_list("client")), ",").alias("clients"))
    alive = F.broadcast(b.gates(spark).where("alive").select(F.col("address").alias("gate"), F.lit("sent").alias("_ok")))  # a handful of rows
    out = sent.join(alive, "gate", "left").select("conv_id", "gate", "clients", F.coalesce("_ok", F.lit("dropped")).alias("outcome"))
    return out.unionByName(bad.select("conv_id", F.lit(None).cast("string").alias("gate"), F.lit(None).cast("string").alias("clients"), F.lit("aborted").alias("outcome")))


@query(with_views("gates") + ", m AS (SELECT conv_id, turn FROM conversations WHERE role = 'system' OR turn = 0), g AS (SELECT address FROM gates WHERE alive) SELECT conv_id, turn, address AS gate FROM m, g UNION ALL SELECT conv_id, turn, NULL FROM m WHERE NOT EXISTS (SELECT 1 FROM g)")
def r16_broadcast(spark, sf_dir):
    """Every message as one envelope for each connected gate; without gates it fails (no gate)."""
    names = sorted(r.address for r in b.gates(spark).where("alive").collect())  # a handful of rows
    m = b.table(spark, sf_dir, "conversations").where("role = 'system' or turn = 0").select("conv_id", "turn")
    return m.select("conv_id", "turn", F.explode_outer(F.array(*map(F.lit, names)).cast("array<string>")).alias("gate"))


@query(with_views("calls") + """, k AS (SELECT DISTINCT object_id FROM calls), h AS (SELECT object_id, list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, strlen(object_id)::bigint + 1),
  lambda i: ('0x' || substr(hex(encode(object_id)), (2*i-1)::int, 2))::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 8 AS worker FROM k) SELECT seq, worker, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS turn FROM calls JOIN h USING (object_id)""")
def r20_keyed_tasks(spark, sf_dir):
    """The worker that takes a call by its key, and the call's turn among those of the key."""
    turn = F.row_number().over(Window.partitionBy("object_id").orderBy("seq")).cast("long")
    return b.calls(spark, sf_dir).select("seq", ids.worker_of(F.col("object_id")).alias("worker"), turn.alias("turn"))


@query(with_views("requests") + "SELECT CASE WHEN status <> 'pending' THEN 'finished' WHEN created_us < (SELECT max(created_us) FROM requests) - 600000000 THEN 'expired' ELSE 'kept' END AS fate, count(*) AS n FROM requests GROUP BY 1")
def r24_cleanup(spark, sf_dir):
    """Finished games go, and those strictly older than ten minutes."""
    r = b.requests(spark, sf_dir)
    now = r.agg(F.max("created_us")).first()[0] or 0
    fate = F.when(F.col("status") != "pending", "finished").when(F.col("created_us") < now - 600_000_000, "expired").otherwise("kept")
    return r.groupBy(fate.alias("fate")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN length(p_name) >= 9 THEN substr(p_name, 10) END AS room, CASE WHEN length(p_type) > 12 THEN substr(p_type, 1, 9) || '...' ELSE p_type END AS label, CASE WHEN p_size - 25 > 0 THEN p_size - 25 ELSE 7 END AS size, 'event: ' || p_brand || e'\\ndata: ' || p_size || e'\\n\\n' AS frame, base64(encode(p_name)) AS body FROM part")
def p11_small_texts(spark, sf_dir):
    """Room names (p11), shortened labels (p22), defaults (p17), event frames (p15) and base64 bodies (p14)."""
    size = ids.positive_or(F.col("p_size") - 25, F.lit(7))
    frame = ids.event_frame(F.col("p_brand"), F.col("p_size").cast("string"))
    return b.table(spark, sf_dir, "part").select("p_partkey", ids.after_prefix(F.col("p_name"), 9).alias("room"), ids.shortened(F.col("p_type"), 12).alias("label"), size.alias("size"), frame.alias("frame"), F.regexp_replace(F.base64("p_name"), "\\s", "").alias("body"))


_PATHS = "paths AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_brand || '/' || p_name || '/Get/x' WHEN 1 THEN p_brand || '/' || p_name WHEN 2 THEN '/' || p_name || '/Get' WHEN 3 THEN p_brand || '//Get' ELSE p_brand || '/' || p_name || '/Set' END AS path FROM part)"


@query(f"""WITH {_PATHS}, s AS (SELECT *, string_split(path, '/') AS x FROM paths), e AS (SELECT *, CASE WHEN len(x) < 3 THEN 'INVALID_PATH' WHEN x[1] = '' OR x[2] = '' OR array_to_string(x[3:], '/') = '' THEN 'INVALID_PARAMETERS' END AS error FROM s)
  SELECT p_partkey, CASE WHEN error IS NULL THEN x[1] END AS type, CASE WHEN error IS NULL THEN x[2] END AS id, CASE WHEN error IS NULL THEN array_to_string(x[3:], '/') END AS method, error FROM e""")
def p14_call_paths(spark, sf_dir):
    """Type, id and method of request paths, or the code of what is wrong (z24: create and delete take two parts alike)."""
    k, brand, name = F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_name")
    path = F.when(k == 0, F.concat(brand, F.lit("/"), name, F.lit("/Get/x"))).when(k == 1, F.concat(brand, F.lit("/"), name)).when(k == 2, F.concat(F.lit("/"), name, F.lit("/Get"))).when(k == 3, F.concat(brand, F.lit("//Get"))).otherwise(F.concat(brand, F.lit("/"), name, F.lit("/Set")))
    p = b.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return p.select("p_partkey", *[c.alias(n) for n, c in ids.call_path(F.col("path")).items()])


@query(with_views("id_samples") + """, h AS (SELECT object_id, list_reduce(list_prepend(1469598103934665603::hugeint, list_transform(range(1, strlen(object_id)::bigint + 1), lambda i: ('0x' || substr(hex(encode(object_id)), (2*i-1)::int, 2))::hugeint)),
  lambda h, c: (xor(h, c) * 1099511628211::hugeint) % 18446744073709551616::hugeint) AS h FROM id_samples) SELECT object_id, (CASE WHEN h >= 9223372036854775808::hugeint THEN h - 18446744073709551616::hugeint ELSE h END)::bigint AS seed FROM h""")
def p21_seeds(spark, sf_dir):
    return b.id_samples(spark, sf_dir).select("object_id", ids.fnv1a64(F.col("object_id")).alias("seed"))


@query("SELECT 'Room-' || r_name AS room, count(n_nationkey) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def z23_rooms(spark, sf_dir):
    r = b.table(spark, sf_dir, "region").join(b.table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return r.groupBy(F.concat(F.lit("Room-"), "r_name").alias("room")).agg(F.count("n_nationkey").alias("members"))


@query(with_views("calls") + "SELECT object_id, count(*) AS increments, arg_max(duration_us, seq) AS last_set FROM calls GROUP BY 1")
def d5_simple_counters(spark, sf_dir):
    """Counters that add one a call (d5), and monitors that keep the last value set (d6)."""
    return b.calls(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("increments"), F.max_by("duration_us", "seq").alias("last_set"))


_LINES = [(1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 4, 7), (2, 5, 8), (3, 6, 9), (1, 5, 9), (3, 5, 7)]
_BOARD = "list_transform(range(1, 10), lambda i: ['X', 'O', '', 'X', 'O'][((event_id * i * i + user_id * i) % 5)::int + 1])"
_WINS = " OR ".join(f"(c[{x}] = {{0}} AND c[{y}] = {{0}} AND c[{z}] = {{0}})" for x, y, z in _LINES)


@query(f"WITH g AS (SELECT event_id, {_BOARD} AS c FROM events) SELECT event_id, CASE WHEN {_WINS.format(chr(39) + 'X' + chr(39))} THEN 'x wins' WHEN {_WINS.format(chr(39) + 'O' + chr(39))} THEN 'o wins' WHEN NOT list_contains(c, '') THEN 'draw' ELSE 'playing' END AS status FROM g")
def d8_board_status(spark, sf_dir):
    """The state of a board of nine fields: eight lines for either side, then a draw when it is full."""
    board = F.expr("transform(sequence(1, 9), i -> element_at(array('X', 'O', '', 'X', 'O'), cast((event_id * i * i + user_id * i) % 5 as int) + 1))")
    g = b.table(spark, sf_dir, "events").select("event_id", board.alias("c"))

    def won(side):
        out = F.lit(False)
        for line in _LINES:
            hit = F.lit(True)
            for at in line:
                hit = hit & (F.element_at("c", at) == side)
            out = out | hit
        return out

    status = F.when(won("X"), "x wins").when(won("O"), "o wins").when(~F.array_contains("c", ""), "draw").otherwise("playing")
    return g.select("event_id", status.alias("status"))


_MATCHES = "matches AS (SELECT o_orderkey AS match, count(*) AS n, min(l_suppkey) AS winner, list(DISTINCT l_suppkey) AS players FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1)"


@query(f"WITH {_MATCHES} SELECT match, unnest(players) AS player, unnest(players) = winner AS won FROM matches")
def d10_match_results(spark, sf_dir):
    """A row for each player of an ended match."""
    return _results(spark, sf_dir)


def _results(spark, sf_dir):
    ended = b.table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("match"))
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match"), F.col("l_suppkey").alias("player")).distinct().join(ended, "match")
    winners = lines.groupBy("match").agg(F.min("player").alias("winner"))
    return lines.join(winners, "match").select("match", "player", (F.col("player") == F.col("winner")).alias("won"))


@query(f"WITH {_MATCHES}, r AS (SELECT match, unnest(players) AS player, unnest(players) = winner AS won FROM matches) SELECT player, count(*) AS total, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, max(match) AS last_match FROM r GROUP BY 1")
def a21_player_stats(spark, sf_dir):
    return _results(spark, sf_dir).groupBy("player").agg(F.count("*").alias("total"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.max_by("match", "match").alias("last_match"))


@query("""WITH s AS (SELECT l_suppkey AS player, count(DISTINCT l_orderkey) AS cycles, count(DISTINCT l_orderkey) + (l_suppkey % 3) - 1 AS total, count(DISTINCT l_orderkey) // 2 AS wins, count(DISTINCT l_orderkey) - count(DISTINCT l_orderkey) // 2 AS losses FROM lineitem GROUP BY l_suppkey)
  SELECT player, total - cycles AS ahead, CASE WHEN total - cycles NOT BETWEEN 0 AND 1 THEN 'count' WHEN total <> wins + losses THEN 'sum' END AS broken FROM s WHERE total - cycles NOT BETWEEN 0 AND 1 OR total <> wins + losses""")
def a20_player_invariants(spark, sf_dir):
    """Players whose matches counted are not the cycles seen or one more, or are not wins and losses together."""
    n = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player")).agg(F.countDistinct("l_orderkey").alias("cycles"))
    s = n.select("player", "cycles", (F.col("cycles") + F.col("player") % 3 - 1).alias("total"), F.floor(F.col("cycles") / 2).alias("wins"))
    ahead, losses = F.col("total") - F.col("cycles"), F.col("cycles") - F.col("wins")
    broken = F.when(~ahead.between(0, 1), "count").when(F.col("total") != F.col("wins") + losses, "sum")
    return s.select("player", ahead.alias("ahead"), broken.alias("broken")).where("broken is not null")


@query(with_views("calls") + "SELECT object_id, max(duration_us) AS observed, arg_max(duration_us, seq) AS stored, arg_max(duration_us, seq) >= max(duration_us) AS ok FROM calls GROUP BY 1")
def a19_monotonicity(spark, sf_dir):
    """A counter's stored value against the largest that was observed."""
    return b.calls(spark, sf_dir).groupBy("object_id").agg(F.max("duration_us").alias("observed"), F.max_by("duration_us", "seq").alias("stored")).withColumn("ok", F.col("stored") >= F.col("observed"))


@query(with_views("calls") + ", l AS (SELECT object_type AS gate, object_id AS client, arg_max(method, seq) AS last FROM calls GROUP BY ALL) SELECT gate, count(*) FILTER (last <> 'error') AS clients FROM l GROUP BY 1")
def z5_client_gauge(spark, sf_dir):
    """Clients of a gate now: those whose last event does not leave (z6: of a gate that joins again the last generation counts)."""
    last = b.calls(spark, sf_dir).groupBy(F.col("object_type").alias("gate"), "object_id").agg(F.max_by("method", "seq").alias("last"))
    return last.groupBy("gate").agg(F.count_if(F.col("last") != "error").alias("clients"))


@query(with_views("calls") + ", l AS (SELECT object_type, object_id, min(seq) AS first_seq, arg_max(method, seq) AS last FROM calls GROUP BY ALL) SELECT object_id, row_number() OVER (PARTITION BY object_type ORDER BY first_seq) - 1 AS place FROM l WHERE last <> 'error'")
def z16_queue_after_leaving(spark, sf_dir):
    """Places of players who are still queued; leaving takes effect even if the player was not there."""
    last = b.calls(spark, sf_dir).groupBy("object_type", "object_id").agg(F.min("seq").alias("first_seq"), F.max_by("method", "seq").alias("last"))
    return placement.ranked(last.where("last <> 'error'"), "first_seq", "place", 4096, ("object_type",)).select("object_id", "place")
