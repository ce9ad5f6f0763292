"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. The plan is made on it: bins with the
same contents are planned together with a multiplicity. Every piece then finds its place from its length and its rank
among pieces of that length, which per-partition counts and one window over those counts give."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize
from .tokens import encoder, public_path

CAPACITY = 2048


class Slot(NamedTuple):
    """Pieces of `length` with ranks from `first` fill bins from `base`, `each` to a bin, the first of them at `offset`."""

    length: int
    first: int
    each: int
    base: int
    offset: int


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slot], int]:
    """(slots, number of bins) for `histogram` (length: pieces).

    A bin takes the longest piece that fits until none does. If a gap is left, its smallest piece goes back when two
    unpacked pieces fill the gap plus its place more tightly; the tightest such pair is taken."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    sizes = np.arange(capacity + 1)
    used = np.zeros(capacity + 1, np.int64)
    slots: list[Slot] = []
    bins = 0
    while left.any():
        take: dict[int, int] = {}
        gap, rest = capacity, left.copy()
        while len(fit := np.flatnonzero(rest[1 : gap + 1])):
            size = int(fit[-1]) + 1
            n = min(int(rest[size]), gap // size)
            take[size] = n
            rest[size] -= n
            gap -= n * size
        if gap:
            small = min(take)
            room = gap + small
            fits = np.maximum.accumulate(np.where(rest > 0, sizes, 0))
            a = np.nonzero(rest[: room + 1])[0]
            b = fits[room - a]
            alone = (b == a) & (rest[a] < 2)
            b = np.where(alone, fits[np.maximum(a - 1, 0)], b)
            pair = np.where(b > 0, a + b, 0)
            if len(pair) and pair.max() > small:
                x = int(pair.argmax())
                take[small] -= 1
                for size in (int(a[x]), int(b[x])):
                    take[size] = take.get(size, 0) + 1
        take = {size: n for size, n in take.items() if n}
        times = min(int(left[size]) // n for size, n in take.items())
        offset = 0
        for size in sorted(take, reverse=True):
            slots.append(Slot(size, int(used[size]), take[size], bins, offset))
            offset += size * take[size]
            used[size] += times * take[size]
            left[size] -= times * take[size]
        bins += times
    return slots, bins


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, style: str, end_id: int, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids, part, rank): every text's ids with `end_id` after them, cut if longer than `capacity`
    (the first piece takes the remainder); rank counts the pieces of one length within a part."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        enc = encoder(tokenizer, style)
        for batch in batches:
            ids_col, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held < 600_000):
                    held += len(texts[hi] or "")
                    hi += 1
                flat, counts = enc.encode([t or "" for t in texts[lo:hi]])
                rows: list[list] = [[] for _ in range(6)]
                end = 0
                for i, n in zip(ids_col[lo:hi], counts.tolist()):
                    ids = np.append(flat[end : end + n], np.uint32(end_id)).astype("<u4")
                    end += n
                    a, b, piece = 0, (len(ids) - 1) % capacity + 1, 0
                    while a < len(ids):
                        rows[0].append(i), rows[1].append(piece), rows[2].append(a), rows[3].append(b - a)
                        rows[4].append(ids[a:b].tobytes()), rows[5].append(int(seen[b - a]))
                        seen[b - a] += 1
                        a, b, piece = b, b + capacity, piece + 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(rows, kinds)]
                arrays.insert(5, pa.array(np.full(len(rows[0]), part, np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids", "part", "rank"])
                lo = hi

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids binary, part long, rank long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored `pieces` (length, part, rank and any others; part and rank are dropped)."""
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    by_part = materialize(by_part.select("length", "part", "n", before.alias("before")), "piece-counts")
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan_bins(histogram, capacity)
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            slot = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            local = rank - slot[:, 1]
            arrays = [batch.column(c) for c in kept] + [pa.array(slot[:, 3] + local // slot[:, 2]), pa.array(slot[:, 4] + local % slot[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("part", "rank")]
    ranked = pieces.join(by_part.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select(*kept, (F.col("before") + F.col("rank")).alias("_rank"))
    schema = ", ".join(f"{c} {t}" for c, t in pieces.select(*kept).dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, style: str = "byte", end_id: int = 0, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(pieces, placed). `pieces` (id, piece, start, length, ids as little-endian unsigned 32-bit numbers, part, rank) is a
    stored table; `placed` has a row per piece with ids_crc32, sequence_id and offset (gapless from 0 in a sequence).

    Null and empty texts give one piece of the end id. Rows with a repeated or null id are packed as rows of their own.
    Other columns are not read. An empty table gives empty results."""
    path = tokenizer or public_path("byte_bpe_50k.json")
    pieces = materialize(tokenized_pieces(docs, id_col, text_col, path, style, end_id, capacity), "pieces")
    small = pieces.select("id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "rank")
    return pieces, pack(small, capacity).withColumnRenamed("id", id_col)
