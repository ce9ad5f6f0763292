"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from keyloom.operators import calls as replay
from keyloom.sources import bindings as b
from keyloom.streaming import twins

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, batch, build, mode, name, files=10):
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    return start(spark, tmp_path, batch.schema, build, mode, name, files)


def start(spark, tmp_path, schema, build, mode, name, files):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_first_arrivals(spark, tmp_path):
    batch = b.calls(spark, SF).select("seq", "call_id")
    got = run(spark, tmp_path, batch, lambda s: twins.first_arrivals(s, "call_id", "seq"), "append", "firsts")
    want = batch.groupBy("call_id").agg(F.min("seq").alias("seq")).select("seq", "call_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_wallets_in_any_order(spark, tmp_path):
    ops = b.wallet_ops(spark, SF).join(b.table(spark, SF, "events").select(F.col("event_id").alias("seq"), F.timestamp_micros(b.micros("ts")).alias("at")), "seq")
    for part in range(3):  # later calls come first, and a third of the calls twice
        ops.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ops.where("seq % 3 = 0").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    end = ops.agg(F.max("at").alias("at")).select(F.lit(10**9).cast("long").alias("seq"), F.lit("none").alias("wallet_id"), F.lit("deposit").alias("kind"), F.lit(1).cast("long").alias("amount"), (F.col("at") + F.expr("interval 900 days")).alias("at"))
    end.select(ops.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = start(spark, tmp_path, ops.schema, lambda s: twins.replay_wallets(s, "at", "60 days"), "update", "wallets", 1)
    last = got.where("wallet_id <> 'none'").groupBy("wallet_id").agg(F.max_by(F.struct("balance", "rejected"), "last_seq").alias("x")).select("wallet_id", "x.*")
    want = replay.replay_wallets(ops).select("wallet_id", "balance", "rejected")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_rates(spark, tmp_path):
    calls = b.calls(spark, SF).select("object_type", F.timestamp_micros("ts_us").alias("at"), "duration_us")
    got = run(spark, tmp_path, calls, lambda s: twins.windowed_rates(s, "object_type", "at", "duration_us"), "update", "rates")
    want = calls.groupBy("object_type", F.window("at", "60 seconds", "15 seconds").alias("w")).count()
    assert {(r.object_type, r.at, r.calls) for r in got.collect()} == {(r.object_type, r.w.end, r["count"]) for r in want.collect()}
