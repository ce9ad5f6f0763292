"""Exact removal of repeated byte strings by column-wise suffix sorting of anchored pieces.

The construction inserts one symbol per piece and round, from the last column to the first, and updates the suffix order
(whose next column of symbols is that column's part of the Burrows-Wheeler transform) and the common-prefix lengths of
neighbours. Over whole documents it would take as many passes as the longest document has bytes, so it runs over pieces:

1. Every window of `length` bytes has an anchor: its `anchor`-byte gram of least hash, leftmost on ties. Equal windows have
   equal anchors at equal places, so only pieces with the same anchor gram can hold equal windows. Consecutive windows with
   one anchor form a piece; a window belongs to exactly one piece.
2. Grams that occur once are dropped by a count and join on their hash. The others' pieces are cut out of the texts,
   written in hash order by a shuffle (Spark spills it to sequential files) and read group by group.
3. Pieces of a group are aligned at the anchor, so equal windows start in the same column. Column by column the order
   and the common prefixes are updated; a window repeats where a neighbour shares `length` symbols or more.

Exact copies of whole texts are counted first; one of each stands for all. Equal pieces of one text are combined before
they leave it. The group of a gram that more than `hot` texts share is divided further: its pieces are cut by the anchor's
place in the window, STEP places together, and grouped by all the bytes that windows of these places have in common around
the anchor. Equal pieces of different texts are then combined in an aggregate, and only distinct ones are sorted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, claim, materialize, ragged, text_bytes

LENGTH = 400
ANCHOR = 64
HOT = 60_000  # texts with one anchor gram beyond which its group is divided
STEP = 16  # places of the anchor that divided pieces keep together
PIECES = 12_000  # pieces sorted together
SEGMENT = 1 << 22  # windows of a text looked at together
_POS = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of all k-grams of the bytes `x`, by doubling."""
    with np.errstate(over="ignore"):
        codes = _CODES[x]

        def up_to(n: int) -> np.ndarray:
            if n == 1:
                return codes
            half = up_to(n // 2)
            both = half[: -(n // 2)] * np.uint64(pow(_BASE, n // 2, 1 << 64)) + half[n // 2 :]
            return both if n % 2 == 0 else both[:-1] * np.uint64(_BASE) + codes[n - 1 :]

        h = up_to(k)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def anchors(x: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Pieces of the concatenated texts `x`, which end at `ends`: (text number, hash, first window, anchor offset, windows)."""
    none = np.empty(0, np.int64)
    if len(x) < length:
        return none, none, none, none, none
    h = gram_hashes(x, k)
    low = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    w, size = length - k + 1, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: size - w], low[w - size :])
    owner = (low & _POS).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(owner)]
    at = np.nonzero(np.arange(len(owner)) + length <= ends[text])[0]
    if not len(at):
        return none, none, none, none, none
    own = owner[at]
    first = np.concatenate(([0], np.nonzero((own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))[0] + 1))
    return text[at[first]], h[own[first]].view(np.int64), at[first], own[first] - at[first], np.diff(first, append=len(at))


def _anchor_rows(length: int, k: int):
    names = ["id", "h", "lo", "at", "n", "first"]

    def flush(ids, parts, bases):
        ends = np.cumsum([len(p) for p in parts])
        text, h, lo, at, n = anchors(np.frombuffer(b"".join(parts), np.uint8), ends, length, k)
        if len(text):
            lo = lo - np.concatenate(([0], ends[:-1]))[text] + np.array(bases)[text]
            order = np.lexsort((h, text))
            first = np.ones(len(h), np.int32)  # 0 where the text had the gram before
            first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
            at_text = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(at_text).cast(pa.int64()), pa.array(h), pa.array(lo), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(first)], names)

    def run(batches):
        claim("suffixes")
        for batch in batches:
            ids, parts, bases, held = [], [], [], 0
            for i, body in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for base in range(0, len(body) - length + 1, SEGMENT):
                    part = body[base : base + SEGMENT + length - 1]
                    ids.append(i), parts.append(part), bases.append(base)
                    held += len(part)
                    if held > 1_500_000:
                        yield from flush(ids, parts, bases)
                        ids, parts, bases, held = [], [], [], 0
            if parts:
                yield from flush(ids, parts, bases)

    return run


def repeated_windows(flat: np.ndarray, offset: np.ndarray, size: np.ndarray, group: np.ndarray, at: np.ndarray, windows: np.ndarray, length: int, keep_first: bool = False) -> np.ndarray:
    """For pieces laid end to end in `flat`, ordered by `group`: a flag per window, in order, if another piece of its group has it.
    With `keep_first`, the first piece that has a window is not flagged.

    One round per column, from the last to the first. `order` holds the pieces by (group, suffix from the column on),
    prefix[i] the symbols that order[i - 1] and order[i] share there."""
    base = np.cumsum(windows) - windows
    found = np.zeros(int(windows.sum()), bool)
    order, prefix = np.arange(len(at)), np.zeros(len(at) + 1, np.int32)
    place, last, grouped = offset + at, size - at, group.astype(np.int64) * 512
    for column in range(int(last.max()) - 1, -int(at.max()) - 1, -1):
        inside = (column < last) & (column >= -at)
        symbols = np.where(inside, flat[np.where(inside, place + column, 0)].astype(np.int64) + 1, 0)
        key = (grouped + symbols)[order]  # symbols[order]: the next column of the transform
        if (key[1:] >= key[:-1]).all():
            prefix[1:-1] = np.where((key[1:] == key[:-1]) & (key[1:] & 511 > 0), prefix[1:-1] + 1, 0)
        else:
            to = np.argsort(key, kind="stable")
            key, order = key[to], order[to]
            same = (key[1:] == key[:-1]) & (key[1:] & 511 > 0)
            shared = prefix[to[1:]]
            far = np.nonzero(same & (to[1:] - to[:-1] > 1))[0]
            if len(far):
                spans = np.stack([to[far] + 1, to[far + 1] + 1], axis=1).ravel()
                shared[far] = np.minimum.reduceat(prefix, spans)[::2]
            prefix[1:-1] = np.where(same, shared + 1, 0)
        long = prefix >= length
        if long.any():
            chosen = long[:-1] | long[1:]
            if keep_first:
                runs = ~long[:-1]  # a run of equal windows starts where the one before shares less
                heads = np.minimum.reduceat(order, np.flatnonzero(runs))
                chosen &= order != heads[np.cumsum(runs) - 1]
            hit = order[chosen]
            start = at[hit] + column
            own = start < windows[hit]
            found[base[hit[own]] + start[own]] = True
    return found


def _sorted_spans(length: int, most: int, keep_first: bool):
    """Reads pieces in order of hash, id, tag and place; yields the spans (id, tag, start, end) that repeated windows cover."""

    def spans(table: pa.Table):
        body = table.column("body").combine_chunks()
        size = np.diff(np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]).astype(np.int64)
        flat = np.frombuffer(b"".join(body.to_pylist()), np.uint8)
        h, at, n = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "at", "n"))
        places = table.column("los").combine_chunks()
        times = places.value_lengths().to_numpy().astype(np.int64)
        los = places.flatten().to_numpy()
        group = np.concatenate(([0], np.cumsum(h[1:] != h[:-1])))
        found = repeated_windows(flat, np.cumsum(size) - size, size, group, at, n, length, keep_first)
        piece = np.repeat(np.arange(len(n)), n)
        if not keep_first:
            found |= (times > 1)[piece]  # the piece stands elsewhere in its own text
        start = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        hit = np.nonzero(found)[0]
        cut = np.nonzero((np.diff(hit) != 1) | (np.diff(piece[hit]) != 0))[0]
        a, b = (hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]) if len(hit) else (hit, hit)
        first = np.cumsum(times) - times
        many = np.ones(len(a), np.int64) if keep_first else times[piece[a]]
        run = np.repeat(np.arange(len(a)), many)  # once for each place of the piece, or for the first
        base = los[ragged(first[piece[a]], many)]
        rows, lo, hi = piece[a][run], base + start[a][run], base + start[b][run] + length
        if keep_first:  # the other places of a piece go as a whole
            rest = np.repeat(np.arange(len(n)), times - 1)
            base = los[ragged(first + 1, times - 1)]
            rows, lo, hi = np.concatenate((rows, rest)), np.concatenate((lo, base)), np.concatenate((hi, base + n[rest] - 1 + length))
        if len(rows):
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(rows), table.column("tag").combine_chunks().take(rows), pa.array(lo), pa.array(hi)], ["id", "tag", "start", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                table = pa.Table.from_batches(held)
                h = table.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))
                if whole:
                    yield from _in_groups(table.slice(0, whole), h[:whole], most, spans)
                held = table.slice(whole).combine_chunks().to_batches()
                rows = len(h) - whole
        if rows:
            table = pa.Table.from_batches(held)
            yield from _in_groups(table, table.column("h").to_numpy(), most, spans)

    return run


def _in_groups(table: pa.Table, h: np.ndarray, most: int, spans):
    """Whole groups, about `most` pieces at a time."""
    lo = 0
    while lo < len(h):
        hi = min(lo + most, len(h))
        if hi < len(h):
            first = int(np.searchsorted(h, h[hi]))
            hi = first if first > lo else int(np.searchsorted(h, h[lo], side="right"))
        yield from spans(table.slice(lo, hi - lo))
        lo = hi


def _cut(length: int):
    """Rows of texts with their pieces' places: yields each distinct piece of a text with all its places (los)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for i, tag, body, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist()):
                pieces: dict[tuple, list[int]] = {}
                spans: dict[tuple, list] = {}
                for p in sorted(places, key=lambda p: p["place"]):
                    lo, at, n = p["place"] >> 24, p["place"] >> 12 & 4095, p["place"] & 4095
                    runs = spans.setdefault((p["h"], lo + at), [])
                    if runs and lo <= runs[-1][1]:  # from another text with this id: a window is in one piece of a group
                        runs[-1][1] = max(runs[-1][1], lo + n)
                    else:
                        runs.append([lo, lo + n])
                for (h, mid), runs in spans.items():
                    for lo, hi in runs:
                        pieces.setdefault((h, mid - lo, body[lo : hi - 1 + length]), []).append(lo)
                for (h, at, part), los in pieces.items():
                    if len(part) < length:  # the place is one of another text with this id
                        continue
                    for column, value in zip(out, (h, i, tag, sorted(los), at, len(part) - length + 1, part)):
                        column.append(value)
                    held += len(part)
                    if held > 4_000_000:
                        yield _piece_batch(out)
                        out, held = [[] for _ in range(7)], 0
            if out[0]:
                yield _piece_batch(out)

    return run


_PIECE = "h long, id long, tag long, los array<long>, at int, n int, body binary"


def _piece_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["h", "id", "tag", "los", "at", "n", "body"])


_PART = "h long, mark binary, id long, tag long, los array<long>, at int, n int, body binary"


def _divide(length: int, anchor: int):
    """Cuts pieces by the anchor's place in the window. A part's group is a hash of the bytes around the anchor that all its
    windows have, its mark a digest of the whole; of equal parts that follow one another in a task only the first has a body."""
    names = ["h", "mark", "id", "tag", "los", "at", "n", "body"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
    context = length - anchor

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for row in batch.to_pylist():
                out: list[list] = [[] for _ in names]
                h, at, n, body = row["h"], row["at"], row["n"], row["body"]
                for j in range((at - n + 1) // STEP, at // STEP + 1):
                    first, last = max(0, at - (j + 1) * STEP + 1), min(n - 1, at - j * STEP)  # windows with the anchor at j * STEP and on
                    if first > last:
                        continue
                    part = body[first : last + length]
                    around = body[at - j * STEP : at] + b"|" + body[at + anchor : at + anchor + max(0, context - (j + 1) * STEP + 1)]
                    group = int.from_bytes(hashlib.blake2b(b"%d %d " % (h, j) + around, digest_size=8).digest(), "little", signed=True)
                    mark = hashlib.blake2b(b"%d %d " % (group, at - first) + part, digest_size=16).digest()
                    fresh = mark not in seen
                    if fresh:
                        seen.add(mark)
                    for column, value in zip(out, (group, mark, row["id"], row["tag"], [lo + first for lo in row["los"]], at - first, last - first + 1, part if fresh else None)):
                        column.append(value)
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _same_row(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["tag"] == b["tag"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, keep_first: bool = False):
    """(rows, spans, copied): `rows` is (id, tag, text), tag telling rows of one id apart; `spans` (id, tag, start, end) are
    covered by repeated windows; `copied` (id, tag, first) lists rows whose whole text occurs in several rows.

    `length` is at most 4,095 bytes; a larger one raises ValueError."""
    if length > 4095:
        raise ValueError("length: 4,095 bytes at most")  # a place is one long: its start, then 12 bits each for `at` and `n`
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    marks = materialize(rows.where(F.octet_length("text") >= length).select("id", "tag", F.md5("text").alias("mark")), "text-marks")
    groups = marks.groupBy("mark").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag")).alias("head")).where("n > 1")
    copied = materialize(
        marks.join(groups, "mark").select("id", "tag", F.struct("id", "tag").eqNullSafe(F.col("head")).alias("first")).distinct(), "copied"
    )
    kind = "id long, h long, lo long, at int, n int, first int"
    found = materialize(rows.select("id", "text").mapInArrow(_anchor_rows(length, anchor), kind), "anchors")
    # written, so that both sides of the join are plain shuffles, of which Spark splits a very frequent gram
    repeated = materialize(found.groupBy("h").agg(F.count("*").alias("n_all"), F.sum("first").alias("texts")).where("n_all > 1"), "repeated-anchors")
    # Places go by id alone: texts that share an id look at each other's places too, which adds pieces and loses none. So a
    # null id may share a key with one that is a number; a plain key keeps one partitioning for both aggregates and the join.
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63))).alias("key")
    place = F.shiftleft("lo", 24).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 12)).bitwiseOR(F.col("n")).alias("place")
    places = found.select("h", key, place).join(repeated, "h")
    by_key = places.groupBy("key").agg(F.collect_set(F.struct("h", "place", "texts")).alias("places"))
    skip = copied.where(~F.col("first")).groupBy(key).agg(F.collect_set(F.struct("id", "tag")).alias("skip"))
    mine = F.expr("not exists(coalesce(skip, array()), s -> s.id <=> id and s.tag = tag)")
    found_in = rows.withColumn("key", key).join(by_key.join(skip, "key", "left"), "key").where(mine).select("id", "tag", "text", "places")
    usual = found_in.withColumn("places", F.filter("places", lambda p: p["texts"] <= hot)).where(F.size("places") > 0)
    pieces = usual.mapInArrow(_cut(length), _PIECE).repartition("h").sortWithinPartitions("h", "id", "tag", F.col("los")[0])
    spans = pieces.mapInArrow(_sorted_spans(length, PIECES, keep_first), "id long, tag long, start long, end long")
    if not repeated.where(F.col("texts") > hot).isEmpty():
        big = found_in.withColumn("places", F.filter("places", lambda p: p["texts"] > hot)).where(F.size("places") > 0)
        parts = materialize(big.mapInArrow(_cut(length), _PIECE).mapInArrow(_divide(length, anchor), _PART), "hot-pieces")
        members = parts.select("mark", "id", "tag", "n", F.explode("los").alias("start"))
        place = F.struct("id", "tag", "start")
        groups = materialize(members.groupBy("mark").agg(F.count("*").alias("times"), F.min(place).alias("head")), "hot-groups")
        bodies = parts.where("body is not null").groupBy("mark").agg(*[F.first(c).alias(c) for c in ("h", "at", "n", "body")])
        one = bodies.join(groups, "mark").select("h", "head.id", "head.tag", F.array("head.start").alias("los"), "at", "n", "body")
        one = one.repartition("h").sortWithinPartitions("h", "id", "tag", F.col("los")[0])
        spans = spans.unionByName(one.mapInArrow(_sorted_spans(length, PIECES, keep_first), "id long, tag long, start long, end long"))
        again = members.join(groups.where("times > 1"), "mark").where(F.lit(not keep_first) | ~place.eqNullSafe(F.col("head")))
        spans = spans.unionByName(again.select("id", "tag", "start", (F.col("start") + F.col("n") - 1 + length).alias("end")))
    return rows, spans, copied


def cut(body: bytes, spans: list[dict] | None, whole: bool | None, length: int) -> tuple[bytes, list[list[int]]]:
    """What is left of a text, and its maximal removed runs."""
    runs: list[list[int]] = []
    if whole and len(body) >= length:
        runs = [[0, len(body)]]
    else:
        for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
    left, end = [], 0
    for a, b in runs:
        left.append(body[end:a])
        end = b
    left.append(body[end:])
    return b"".join(left), runs


def _removed(length: int):
    names = ["id", "tag", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            size, gone, count, kept, lo, held = [], [], [], [], 0, 0

            def block(hi):
                arrays = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)] + [pa.array(c, pa.int64()) for c in (size, gone, count)]
                return pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary())], names)

            rows = zip(text_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            for row, (body, spans, whole) in enumerate(rows, 1):
                left, runs = cut(body, spans, whole, length)
                size.append(len(body)), gone.append(sum(b - a for a, b in runs)), count.append(len(runs)), kept.append(left)
                held += len(body)
                if held > 4_000_000:
                    yield block(row)
                    size, gone, count, kept, lo, held = [], [], [], [], row, 0
            if size:
                yield block(batch.num_rows)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: the remaining UTF-8 bytes).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another; all
    occurrences go, judged on the input. Matches never cross rows. Null texts count as empty; rows that repeat (same id
    and text) are separate texts, so each is the other's copy; a null id is kept as an id. Other columns are not read."""
    rows, verdict = verdicts(docs, id_col, text_col, length, anchor, hot)
    joined = rows.join(verdict, _same_row(rows, verdict), "left").select(rows["id"], rows["tag"], "text", "spans", "whole")
    kind = "id long, tag long, n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInArrow(_removed(length), kind).withColumnRenamed("id", id_col)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, verdict): rows as of repeated_spans; verdict (id, tag, spans, whole) of the rows that lose bytes, without texts.

    With `keep_first`, each string's occurrence of the least (id, tag, place) is left; of rows equal in id and text, all that
    one of them loses all lose."""
    rows, spans, copied = repeated_spans(docs, id_col, text_col, length, anchor, hot, keep_first)
    if keep_first:
        copied = copied.where(~F.col("first"))
    # the longest end of each start, so that many equal spans of one text come as one
    per_row = spans.groupBy("id", "tag", "start").agg(F.max("end").alias("end"))
    per_row = per_row.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.lit(False).alias("whole"))
    whole = copied.select("id", "tag", F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.lit(True).alias("whole"))
    return rows, per_row.unionByName(whole).groupBy("id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.max("whole").alias("whole"))
