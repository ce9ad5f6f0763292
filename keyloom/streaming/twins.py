"""Structured Streaming forms of batch operators."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_arrivals(stream: DataFrame, key: str, order: str, at: str | None = None, horizon: str | None = None) -> DataFrame:
    """One row per key, the first to arrive; of a micro-batch's rows that of the least `order`. Without a horizon the state
    keeps every key, as exactly-once needs; with one, duplicates later than that by event time may pass, and of a
    micro-batch's duplicates any may be taken."""
    if horizon:
        return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])

    def first(_, frames, state: GroupState):
        rows = pd.concat(list(frames))
        if not state.exists:
            state.update((True,))
            yield rows.nsmallest(1, order)

    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def windowed_rates(stream: DataFrame, key: str, at: str, value: str, span: str = "60 seconds", every: str = "15 seconds", late: str = "2 minutes") -> DataFrame:
    """Calls and mean value per key in sliding windows by event time; rows later than `late` are not counted."""
    w = F.window(at, span, every)
    return stream.withWatermark(at, late).groupBy(key, w).agg(F.count("*").alias("calls"), F.avg(value).alias("mean")).select(key, F.col("window.end").alias("at"), "calls", "mean")


def replay_wallets(stream: DataFrame, at: str, late: str = "2 minutes") -> DataFrame:
    """Wallet balances after each micro-batch (wallet_id, balance, rejected, last_seq, late).

    Calls may arrive in any order: each waits until the watermark, `late` behind the newest `at`, has passed its time, and
    those that have are then taken by seq. A call that comes after a later one was taken is a duplicate or too late for
    its place; it changes nothing and is counted in `late`. A null amount is rejected."""

    def fold(key, frames, state: GroupState):
        balance, rejected, last, dropped, held = state.get if state.exists else (0, 0, -1, 0, "[]")
        waiting = {int(s): (t, kind, amount) for s, t, kind, amount in json.loads(held)}
        if not state.hasTimedOut:
            for frame in frames:
                for seq, t, kind, amount in zip(frame.seq, frame[at], frame.kind, frame.amount):
                    if seq <= last:
                        dropped += 1
                    elif int(seq) not in waiting:
                        waiting[int(seq)] = (int(t.timestamp() * 1000), kind, 0 if pd.isna(amount) else int(amount))
        now = state.getCurrentWatermarkMs()
        for seq in sorted(waiting):
            t, kind, amount = waiting[seq]
            if t > now:
                break
            del waiting[seq]
            last = seq
            if amount <= 0 or (kind == "withdraw" and amount > balance):
                rejected += 1
            else:
                balance += amount if kind == "deposit" else -amount
        state.update((balance, rejected, last, dropped, json.dumps([(s, *w) for s, w in waiting.items()])))
        if waiting:
            state.setTimeoutTimestamp(max(now, min(t for t, _, _ in waiting.values())) + 1)
        yield pd.DataFrame([(key[0], balance, rejected, last, dropped)], columns=["wallet_id", "balance", "rejected", "last_seq", "late"])

    timed = stream.withWatermark(at, late).select("wallet_id", "seq", at, "kind", "amount")
    return timed.groupBy("wallet_id").applyInPandasWithState(
        fold, "wallet_id string, balance long, rejected long, last_seq long, late long", "balance long, rejected long, last long, late long, held string", "update", GroupStateTimeout.EventTimeTimeout
    )
