"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from keyloom import registry
from keyloom.functions import ids, policy
from keyloom.operators.calls import replay_wallets
from keyloom.operators.store import compare_and_set
from keyloom.plans.placement import assign, rebalance, rebalance_plan
from keyloom.sources import bindings as b

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


def rows(frame):
    def plain(x):
        if pd.isna(x):
            return "~"
        return str(x) if isinstance(x, (str, bool)) or type(x).__name__ == "bool" else round(float(x), 6)

    return sorted([tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_rebalance_spreads_and_stops():
    moves = rebalance({"a": 10, "b": 0, "c": 2}, {"a": list(range(10))}, 12, 100)
    load = {"a": 10, "b": 0, "c": 2}
    for _, x, y in moves:
        load[x] -= 1
        load[y] += 1
    assert max(load.values()) - min(load.values()) < 2
    assert moves[0] == (0, "a", "b")
    assert rebalance({"a": 10, "b": 0}, {}, 10, 100) == []
    assert len(rebalance({"a": 100, "b": 0}, {"a": list(range(100))}, 100, 5)) == 5


def test_no_live_node_gives_no_plan(spark):
    assert assign(b.shards(spark), b.nodes(spark).where("false")).count() == 0
    open_shards = b.shards(spark).withColumn("target_node", F.when(F.col("shard_id") > 0, F.col("target_node")).otherwise(""))
    assert rebalance_plan(open_shards, b.nodes(spark).where("alive")).count() == 0


def test_a_shard_moves_once():
    moves = rebalance({"a": 9, "b": 0}, {"a": [5, 1, 3], "b": []}, 9, 100)
    assert moves == [(1, "a", "b"), (3, "a", "b"), (5, "a", "b")]


def test_wallets_with_nulls(spark):
    ops = spark.createDataFrame([(1, None, "deposit", 5), (2, "w", "deposit", 9), (3, "w", "deposit", None), (4, "w", "withdraw", 4), (5, None, "withdraw", 9)], "seq long, wallet_id string, kind string, amount long")
    got = {r.wallet_id: tuple(r)[1:] for r in replay_wallets(ops).collect()}
    assert got == {None: (5, 1, 5, 0), "w": (5, 1, 9, 4)}


def test_of_two_proposals_on_one_revision_the_first_wins(spark):
    state = spark.createDataFrame([("k", 5)], "key string, mod_revision long")
    asked = spark.createDataFrame([("k", 10, 5), ("k", 11, 5), ("k", 12, 10), ("k", 13, 12), ("k", 14, 99), ("new", 20, 0), (None, 21, 0)], "key string, proposal long, expected long")
    outcomes, after = compare_and_set(state, asked, "key")
    assert {r.proposal for r in outcomes.where("applied").collect()} == {10, 12, 13, 20} and outcomes.count() == 7
    assert {r.key: r.mod_revision for r in after.collect()} == {"k": 13, "new": 20}


def test_a_first_revision_above_the_proposals(spark):
    state = spark.createDataFrame([("k", 12), ("n", 50)], "key string, mod_revision long")
    asked = [("k", 9, 12), ("k", 10, 9), ("k", 11, 12), ("k", 12, 10), ("k", 13, 12), ("n", 49, 51), ("n", 50, 50), ("n", 51, 50)]
    outcomes, after = compare_and_set(state, spark.createDataFrame(asked, "key string, proposal long, expected long"), "key")
    assert {(r.key, r.proposal) for r in outcomes.where("applied").collect()} == {("k", 9), ("k", 10), ("k", 12), ("k", 13), ("n", 50), ("n", 51)}
    assert {r.key: r.mod_revision for r in after.collect()} == {"k": 13, "n": 51}


@pytest.mark.parametrize("name", ["m9_compare_and_set", "m9_state_after"])
def test_shards_beyond_the_table_of_shards(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (user_id * 1000 AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(want)


def test_hash_of_any_text(spark):
    vectors = {"": 7621, "a": 2348, "foobar": 6504, "object-1": 4812, "unicode-\u6d4b\u8bd5-test": 2508, "n:1/y": 6636}
    frame = spark.createDataFrame([(k,) for k in vectors], "id string")
    assert {r.id: r.s for r in frame.select("id", ids.shard_id(F.col("id")).alias("s")).collect()} == vectors


def test_bad_rules_are_refused():
    for rule in (policy.Rule("", "", "", "ALLOW"), policy.Rule("x", "", "", "MAYBE"), policy.Rule("/(/", "", "", "ALLOW")):
        with pytest.raises(ValueError):
            policy.check([rule])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
