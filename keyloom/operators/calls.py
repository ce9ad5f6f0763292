"""Ordered per-key replay of call logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay_wallets(ops: DataFrame) -> DataFrame:
    """Balance, rejections and accepted totals per wallet, calls taken strictly by seq.

    An amount of zero or less, or null, is rejected, and so is a withdrawal above the balance; a rejection leaves the
    balance. Calls without a wallet belong to the wallet null. Every balance depends on the one before, so a wallet's calls
    are taken one by one: they are sorted by Spark and folded in Arrow batches, where a hot wallet streams through and is
    never one row, as it would be in an aggregate over a collected array."""

    def fold(batches):
        key, state = None, None
        for batch in batches:
            rows = []
            for wallet, kind, amount in zip(batch.wallet_id, batch.kind, batch.amount.fillna(0).astype("int64")):
                if state is None or wallet != key:
                    if state is not None:
                        rows.append((key, *state))
                    key, state = wallet, [0, 0, 0, 0]
                if amount <= 0 or (kind == "withdraw" and amount > state[0]):
                    state[1] += 1
                elif kind == "deposit":
                    state[0] += amount
                    state[2] += amount
                else:
                    state[0] -= amount
                    state[3] += amount
            yield pd.DataFrame(rows, columns=["wallet_id", "balance", "rejected", "deposited", "withdrawn"])
        if state is not None:
            yield pd.DataFrame([(key, *state)], columns=["wallet_id", "balance", "rejected", "deposited", "withdrawn"])

    dealt = ops.select("wallet_id", "seq", "kind", "amount").repartition("wallet_id").sortWithinPartitions("wallet_id", "seq")
    return dealt.mapInPandas(fold, "wallet_id string, balance long, rejected long, deposited long, withdrawn long")


def counters_since_reset(ops: DataFrame, key: str, order: str, reset: str, amount: str) -> DataFrame:
    """Per key the sum of amounts after the last reset."""
    last = ops.groupBy(key).agg(F.max(F.when(F.expr(reset), F.col(order))).alias("_last"))
    joined = ops.join(last, key)
    counted = F.when(~F.expr(reset) & (F.col("_last").isNull() | (F.col(order) > F.col("_last"))), F.col(amount)).otherwise(0)
    return joined.groupBy(key).agg(F.sum(counted).alias("value"), F.count_if(F.expr(reset)).alias("resets"))


def replies(calls: DataFrame, log: DataFrame) -> DataFrame:
    """What each arriving call (call_id) is told from the log (call_id, status, result, error, cursor of its object, seq).

    A finished call gets its stored result or error, failed and skipped apart; a pending one waits, or was left behind if
    the cursor has passed it; an unknown one is new."""
    joined = calls.join(log, "call_id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "new")
        .when(F.col("status").isin("success", "failed", "skipped"), F.col("status"))
        .when(F.col("status") != "pending", "unknown")
        .when(F.col("seq") < F.col("cursor"), "left behind")
        .otherwise("waits")
    )
    return joined.withColumn("outcome", outcome).withColumn("answer", F.when(F.col("status") == "success", F.col("result")).when(F.col("status").isin("failed", "skipped"), F.col("error")))
